"""Select, explain, draw, frame and count corpora of files, many projects at once, on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the few Python helpers along with each job and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from packloom.operators.config import ScanConfig  # noqa: E402

__all__ = ["ScanConfig"]
