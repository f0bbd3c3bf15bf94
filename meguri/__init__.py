"""meguri: coverage resolution for building records on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel with the job, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
