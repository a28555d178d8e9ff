"""Search, browse and document-processing operators as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# functions go to the workers by value: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
