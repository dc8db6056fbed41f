"""Fleet configuration analytics as Spark DataFrame work.

Every operator is a function from DataFrames to a DataFrame, so Catalyst sees one
declarative plan from scan to sink.  See README.md for the map of modules.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python task functions travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
