"""Operational-event analytics as DataFrame-to-DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

# Workers need not have the package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
