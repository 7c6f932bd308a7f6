"""All registered queries, by operator family."""

from cohortry.catalog import (  # noqa: F401
    activity,
    engagement,
    experiment,
    frames,
    guards,
    mechanisms,
    offers,
    primitives,
    uplift,
)
from cohortry.catalog._base import CATALOG

__all__ = ["CATALOG"]
