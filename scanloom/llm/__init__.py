"""Operators for training-data pipelines on text tables.

Nothing else in the library imports this subpackage.  Python functions that run
on executors are pickled by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
