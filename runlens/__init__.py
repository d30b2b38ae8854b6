"""Spark jobs that evaluate text-classification runs.

Posts and model answers come in as tables; prompts, decisions, metrics, error
slices, topics and retrieved context go out as tables.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so nothing has to be
# installed there besides numpy, pandas and pyarrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
