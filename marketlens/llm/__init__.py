"""Operators that prepare a text corpus for training.

Functions that run in Spark's Python workers are sent along with the job, so executors
need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
