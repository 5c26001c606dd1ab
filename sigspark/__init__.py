"""Nanopore signal analytics expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel inside the tasks, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
