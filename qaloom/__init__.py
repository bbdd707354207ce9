"""qaloom: question-answering data, retrieval and scoring as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run in Python workers travel with the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
