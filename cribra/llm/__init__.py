"""Training-data operators over document, page and embedding tables.

Every operator takes DataFrames and column names and returns DataFrames. Nothing
else in the library imports this subpackage.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel by value, so executors need no
# copy of this package on their path.
register_pickle_by_value(sys.modules[__name__])
