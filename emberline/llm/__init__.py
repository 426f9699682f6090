"""Operators for training corpora. Their task functions travel by value, so executors need not have this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
