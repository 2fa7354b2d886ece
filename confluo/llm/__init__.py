"""Operations of a training-data pipeline on Spark DataFrames.

Every operator takes a DataFrame with an integer id column and a text column
(names are parameters) and returns a DataFrame.  Nothing else in the library
imports this subpackage.  Functions that run in Python workers are pickled by
value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
