"""Change-log pipelines on Spark: every operator is a DataFrame-to-DataFrame function."""

import sys

from pyspark import cloudpickle

# The helpers that run inside tasks travel with the task, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
