"""Operators for large text corpora: deduplication, scans, quality, mixing, packing and token output.

Functions of this package that run in Python workers are pickled by value, so
executors need the libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
