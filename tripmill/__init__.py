"""Labelled GPS points to travel-mode evidence, as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
