"""cairn: evidence retrieval and memory analytics as PySpark DataFrame operators.

Functions sent to Python workers are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
