"""Stream-application telemetry analysis on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame, so it composes
with ``DataFrame.transform`` and runs lazily until the caller asks for rows.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Pandas functions travel to the executors with the task that calls them, so the
# package has to be installed only where the driver runs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
