"""Spark-native analytics for raster-scan imaging, and operators for training-data pipelines.

Python functions that run on executors are pickled by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
