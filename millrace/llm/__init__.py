"""Operators for preparing training data: deduplication, filtering, extraction, tokens.

Nothing outside this subpackage imports it. Its functions are sent to the
executors by value, so that it need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
