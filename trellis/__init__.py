"""Trellis: analytics over multi-turn interaction data, as DataFrame, SQL and streaming operations.

Functions that run on executors travel by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
