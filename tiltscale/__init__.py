"""Rate news articles for political bias with Spark batch and streaming jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers with their tasks, so it
# does not have to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
