"""Spark-native text-feature analytics: documents in, document x feature tables out."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel with the task, so the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
