"""lumenframe: PySpark-native analytics over visual-detection data and text corpora.

Functions take and return DataFrames; Catalyst picks the physical plan.
Functions that run inside tasks are shipped by value, so executors need no
installed copy of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
