"""Security analytics over web-server and SSH logs as DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
