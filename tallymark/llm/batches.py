"""Size of the batches in which whole texts travel between Spark and Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts in a batch at most; Spark's default of 10,000 rows suits short rows.
TEXTS = 1000


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after lowering the session's batch size to ``TEXTS`` rows where it is larger."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(CONF)) <= TEXTS:
        conf.set(CONF, str(TEXTS))
    return docs
