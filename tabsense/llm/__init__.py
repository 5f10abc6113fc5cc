"""Operators for preparing training text at scale.

Nothing else in the library imports this package.  The functions that run in
Python workers are shipped by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
