"""caslake: a Spark-first engine for content-addressed, event-sourced file indexes.

Functions that run on executors are sent by value, so executors need not have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
