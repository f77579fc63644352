"""wordrate: word-rating estimation and agreement analysis as Spark DataFrame jobs.

Sub-packages
------------
functions  Column expressions (text parsing, numeric coercion, token scoring).
sources    Readers: CSV / JSONL / whole-text / XLSX data source / experiment catalogue.
sinks      Writers: chunked JSONL request files, versioned workbook rewrite, split outputs.
operators  DataFrame -> DataFrame operators (requests, responses, joins, splits, statistics).
streaming  Structured Streaming ingest of result files.
plans      The registered queries over the driver tables and their DuckDB oracle SQL.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions that run in tasks are pickled by value, so executors need no copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
