"""Operators for preparing large text corpora for training.

Every operator takes and returns DataFrames. Nothing else in the library
imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
