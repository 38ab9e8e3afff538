"""Article digests, knowledge curation and training-data preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
