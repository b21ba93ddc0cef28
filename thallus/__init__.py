"""thallus: community-ecology analytics as plain Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame.  The package is shipped
to Python workers by value, so executors need no copy of it on their path.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
