"""Analysis of large collections of measurement runs on Spark."""

import sys

from pyspark import cloudpickle

# Task code is sent with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
