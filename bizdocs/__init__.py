"""bizdocs: business-document analytics on Spark DataFrames and streams."""

import sys

from pyspark import cloudpickle

# Helpers inside UDFs travel to executors by value, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
