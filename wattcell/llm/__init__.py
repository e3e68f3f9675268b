"""Operators of a training-data pipeline: filtering, deduplication, scoring, formatting and mixing of text corpora.

Functions that run inside Arrow batches travel with the job, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
