"""Training-data operators: secrets, quality, tokens, contamination, toxicity,
language, repeated passages, shards and near-duplicates.

Nothing outside this package imports it.  Its functions travel to executors by
value, so executors need only the public libraries named in the README.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
