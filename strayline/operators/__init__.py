"""Operators on DataFrames.

The functions that run in tasks travel there by value, so nothing needs to be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
