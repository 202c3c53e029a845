"""Re-identification of individuals from repeated observations, as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the job, so executors need no copy
# of this package.
register_pickle_by_value(sys.modules[__name__])
