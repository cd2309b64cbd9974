"""tracelode: a Spark-native analytics engine for event traces of tool-using agents."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
