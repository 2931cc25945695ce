"""Operators for preparing training data: deduplication, filtering, formatting, tokens, packing, sharding.

Nothing else in the library imports this package. Its Python functions travel to the
executors by value, so workers need the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
