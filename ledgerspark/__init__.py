"""Spark-native back-office analytics: reconciliation, settlement checks, cash forecasts, corpus operators.

The few Python functions that run on executors travel by value, so a cluster
needs no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
