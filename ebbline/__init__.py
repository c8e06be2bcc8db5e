"""Ebbline: time-series risk analytics and corpus preparation as Spark jobs.

Functions that run in Python workers travel by value, so a cluster needs no
installed copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
