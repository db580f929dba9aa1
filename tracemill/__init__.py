"""tracemill: a PySpark-native analytics engine for the work history of coding agents."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel with the tasks that run them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
