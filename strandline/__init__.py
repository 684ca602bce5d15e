"""Interval, sequence-graph and corpus analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers carry their helpers with them, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
