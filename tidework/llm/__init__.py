"""Operators for preparing training text: scoring, scanning, fingerprinting, near-duplicates, mixing and packing.

Functions that run inside tasks are sent by value, so executors need numpy and
pyarrow but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
