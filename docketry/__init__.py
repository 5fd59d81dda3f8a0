"""docketry: Spark jobs for a document back-office and for training-data corpora.

Functions that run inside Python workers are pickled by value, so the executors
need Python, numpy and pyarrow but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
