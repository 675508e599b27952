"""caseward: quality control of labelled imaging datasets as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions that run inside tasks travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
