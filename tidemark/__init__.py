"""tidemark: keyed time-series analytics on Spark DataFrames."""

import sys

__version__ = "0.1.0"

# Python functions shipped to executors (grouped / mapped pandas functions)
# reference helpers in this package.  Pickling the package by value means the
# executors do not need it installed or on their path.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
