"""Operators for preparing training data at scale."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers with their code, so
# that executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
