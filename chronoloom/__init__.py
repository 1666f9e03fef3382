"""Timeline analytics as Spark DataFrame operators.

Functions of this package that run in Python workers are shipped by value, so an
executor needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
