"""leadloom: evidence-first web-store analytics expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers as they are: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
