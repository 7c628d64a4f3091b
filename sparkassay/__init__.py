"""Question, retrieval and evaluation analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel with their code, so executors need neither this package installed nor its folder on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
