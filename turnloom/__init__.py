"""A PySpark-native engine for dialogue-data building, curation and evaluation."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions travel to executors by value, so that these needn't have the package installed.
register_pickle_by_value(sys.modules[__name__])
