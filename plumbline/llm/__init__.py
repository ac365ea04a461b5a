"""Operators for training-data pipelines; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# workers need not have this package installed: its functions are shipped by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
