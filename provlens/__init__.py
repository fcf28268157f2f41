"""Provenance and integrity questions over many archives, as Spark DataFrames.

Every table carries ``archive_id`` and every operator maps DataFrames to a
DataFrame, so one call answers a question for one archive or for thousands.
"""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
