"""Security-log analytics on Spark DataFrames: parse, score, triage, watch."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors get this package's functions with the tasks that use them, so it
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
