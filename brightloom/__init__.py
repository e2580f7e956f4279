"""brightloom: labelled time series and log analytics, expressed as Spark plans.

Executors need not have the package installed: its Python functions are
shipped by value with the plans that use them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
