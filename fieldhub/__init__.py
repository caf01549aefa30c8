"""Facility supply, demand and hub-siting analytics as PySpark DataFrame operators.

Functions of this package reach the Python workers by value, so executors need no copy of it
and a session may start in any folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
