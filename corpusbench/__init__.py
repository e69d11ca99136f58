"""Speech-corpus collection and evaluation as DataFrame-to-DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Ship the few Arrow functions with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
