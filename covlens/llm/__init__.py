"""Training-data operators: language id, packing, deduplication, sharding, quality, PII, decontamination, extraction.

Nothing else in the library imports this subpackage. Its functions that run
inside Spark's Python workers are shipped by value, so a cluster needs no
copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
