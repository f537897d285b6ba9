"""A Spark-native analytics engine for polygenic scores."""

import sys

from pyspark import cloudpickle

# Executors need not have this repository on their path: its functions are sent with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
