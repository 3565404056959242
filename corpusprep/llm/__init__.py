"""Operators of a training-data pipeline; nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# The functions that run in tasks travel by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
