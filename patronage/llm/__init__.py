"""Operators for preparing training text, one module each.

Nothing outside this package imports it.  Its Python helpers are sent to the
executors by value, so these need the third-party libraries only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
