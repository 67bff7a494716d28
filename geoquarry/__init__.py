"""Earth-observation question-answering analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Kernels travel with the task that runs them, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
