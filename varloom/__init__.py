"""Mutation-event features and model comparison on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they need no copy of the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
