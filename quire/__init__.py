"""quire: corpus, retrieval and embedding-table jobs expressed as Spark DataFrame plans."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Ship this package's functions to Python workers by value, so executors need no install.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
