"""Spark-native analytics for sequencing-alignment tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run on executors travel by value, so that no executor needs the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
