"""Spark library for running a manuscript-translation business as tables and streams."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to the executors with the job that uses them, so the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
