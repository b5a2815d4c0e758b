"""weftline: a PySpark-native change-context analytics engine.

Operators are plain functions from DataFrames to DataFrames.  The few that need Python on the
executors are shipped with the task itself (pickled by value), so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
