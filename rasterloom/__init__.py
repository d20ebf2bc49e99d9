"""Analytics on scanned pages and text corpora with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: only the driver needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
