"""Operators of a training-data pipeline. Nothing outside this folder and corpus_pipeline.py imports it."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
