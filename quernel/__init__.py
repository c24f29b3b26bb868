"""quernel: hybrid search, opinion analytics and corpus preparation as plain Spark plans."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
