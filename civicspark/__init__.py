"""Civic open-data analytics on PySpark.

Operators are plain functions ``f(df, ..., params) -> DataFrame``; sources read
landed files, ``plans`` wires operators to the benchmark tables, ``streaming``
holds the live jobs.
"""

import sys

from pyspark import cloudpickle

# Arrow/pandas helpers travel to executors by value, so the package does not
# have to be installed on every worker.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
