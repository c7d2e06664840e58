"""Analytics over structured legal and corpus text, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get the functions by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
