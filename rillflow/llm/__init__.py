"""Training-data operators: deduplication, packing, sharding, filtering.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrame to DataFrame; ``queries`` holds the thin per-operator queries.
"""

import sys

from pyspark import cloudpickle

#: Executors get these functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
