"""Spark-native tabular synthesis, privacy and fidelity analytics.

Every public operator takes DataFrames and returns DataFrames.  Only results with one row per
column (or per pair of columns) are ever brought to the driver; data rows never are.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# the few Arrow functions travel inside the plan, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
