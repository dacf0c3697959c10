"""Operators of a training-data pipeline. Nothing else in the library imports this."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The functions that run in tasks travel with them, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
