"""Prose-document analytics on Spark: regions, sentences, formatting, checks and diffs as DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
