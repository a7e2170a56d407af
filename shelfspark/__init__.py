"""Product-catalogue and embedding-search operators for PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the plan, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
