"""Operators for large training-data pipelines; nothing else in the library imports this subpackage.

Functions that run on executors are sent by value, so executors need not have the library installed. Code that runs
there refers to functions and constants of these modules, not to the modules.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
