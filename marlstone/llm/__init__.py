"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get the code with the functions they run, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
