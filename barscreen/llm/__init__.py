"""Operators for large text corpora: training data for language models."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
