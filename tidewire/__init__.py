"""A PySpark-native engine for collecting, organising and querying short published content."""

import sys

from pyspark import cloudpickle

# executors need not have this package installed: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
