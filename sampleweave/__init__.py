"""Sample-by-feature matrices, the networks derived from them, and linear learning, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python functions travel inside their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
