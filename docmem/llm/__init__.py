"""Operators of a training-data pipeline; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Workers need no copy of the package: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
