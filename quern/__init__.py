"""Quern: hybrid search and incremental text indexing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so a
# cluster needs no copy of the package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
