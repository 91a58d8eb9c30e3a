"""Dataset measurement and preparation on Spark.

Content digests of tables, files and streams as Spark aggregations; word
statistics, vocabularies, token sequences, prompts and features as DataFrame
operators; evidence tables that bind the digests together.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
