"""Spend analytics over mail archives, as Spark jobs on DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions travel to the executors with the task, so the
# package has to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
