"""Race telemetry analytics on Spark: alignment, features, detection, flags and scoring."""

import sys

from pyspark import cloudpickle

# Functions handed to Arrow workers travel with the job, so executors need no install step.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
