"""Plinth: code-analytics and data-preparation operators on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to the executors by value, so that the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
