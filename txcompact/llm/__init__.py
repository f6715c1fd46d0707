"""Operators of a training-data pipeline. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions go to executors whole, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
