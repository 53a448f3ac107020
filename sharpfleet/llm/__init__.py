"""Operators for text corpora: extraction, cleaning, deduplication, scoring and packing of documents.

The functions that tasks run are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
