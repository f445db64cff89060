"""Training-data operators (sharding, extraction, filters, dedup, packing).

Nothing outside this package and ``corpus_pipeline.py`` imports it. Its functions travel
to the executors with the tasks, so nothing needs to be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
