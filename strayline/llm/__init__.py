"""Operators that prepare text corpora for training.

Their functions travel to the executors by value, so nothing needs to be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
