"""Operators for training-data corpora. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# What runs on executors is sent with its code, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
