"""Operators for preparing training text at scale; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: a cluster needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
