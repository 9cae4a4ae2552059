"""Security analytics on Spark: code facts, detection rules, risk, response, CVEs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
