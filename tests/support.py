"""Helpers for small frames."""

from __future__ import annotations

import math


def rows(df, *order):
    """Rows as plain dicts, sorted by the given columns."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    if order:
        out.sort(key=lambda r: tuple((r[c] is None, r[c]) for c in order))
    return out


def one(df):
    (row,) = rows(df)
    return row


def same_rows(left, right, places: int = 6) -> bool:
    """The two frames hold the same rows, floats compared at some places."""

    def key(df):
        names = sorted(df.columns)

        def plain(v):
            if isinstance(v, float):
                return None if math.isnan(v) else round(v, places)
            return tuple(v) if isinstance(v, list) else v

        return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)

    return sorted(left.columns) == sorted(right.columns) and key(left) == key(right)
