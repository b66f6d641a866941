"""Timed-memory analytics as plain functions from DataFrames to DataFrames.

The few functions that run inside Python workers are shipped with the job itself, so executors need no
copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
