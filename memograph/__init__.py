"""memograph: reuse of previously solved document work, expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from memograph.session import build_session

# Callbacks travel to Python workers with the code of this package, which need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
