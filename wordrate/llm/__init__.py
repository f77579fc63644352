"""Operators of a training-data pipeline: joins and deduplication of texts and vectors,
tokenising, packing, page extraction, toxicity and personal data.

Functions that run in tasks are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
