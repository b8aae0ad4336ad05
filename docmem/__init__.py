"""docmem: adaptive-schema document memory on Spark.

Edits, records and messages of many owners are rows; documents, schemas,
contexts and search results are DataFrames derived from them.
"""

import sys

from pyspark import cloudpickle

# Workers need no copy of the package: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
