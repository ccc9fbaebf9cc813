"""kernelforge: hierarchical kernel-matrix analytics on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executors get the functions with the task, so nothing has to be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
