"""Operators for large training-data corpora; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Tasks get the subpackage's own functions by value: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
