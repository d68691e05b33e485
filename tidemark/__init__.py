"""tidemark: relational prediction analytics as lazy Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
