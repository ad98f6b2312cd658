"""shoplens: retail catalog, behaviour and recommendation analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the library's functions with the task, so executors need
# no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
