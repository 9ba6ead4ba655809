"""Spark-first de-identification of documents: detection, linking, substitution, review and export."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with each task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
