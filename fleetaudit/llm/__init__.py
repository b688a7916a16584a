"""Operators on training text.

Functions of this package that run in tasks are pickled by value, so that
executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
