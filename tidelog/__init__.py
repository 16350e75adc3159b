"""Event-archive analytics on Spark: audit, quality, curation and training-data operators."""

import sys

from pyspark import cloudpickle

# Functions that run on workers are shipped with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
