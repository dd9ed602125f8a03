"""Spark-native card-fraud feature, graph, model and scoring operators.

Every operator takes and returns Spark DataFrames; the heavy work is
joins, aggregations, windows and shuffles planned by Catalyst.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions that run inside tasks are shipped by value: workers need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
