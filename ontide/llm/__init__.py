"""Operators of a training-data pipeline: cleaning, duplicates, leaks, tokens, archives, scores.

Nothing outside this package imports it. Functions that run on the executors are pickled
by value, so the executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
