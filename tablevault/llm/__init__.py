"""Operators for preparing language-model training data. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
