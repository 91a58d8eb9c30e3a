"""Shared storage and small-table helpers used by the operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SPREAD_PIECES = 32
#: Spark's own setting: shuffle files are deleted when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none gets a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallymark-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def without_leftovers(spark: SparkSession):
    """Queries that run inside leave no shuffle files behind; the session keeps its setting."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage and survives lost executors; unlike a checkpoint it is
    columnar, and its size is known to the planner. The shuffle files of the
    write go with its end, as nothing but the write can read them.
    """
    path = fresh_path(df.sparkSession, "table")
    with without_leftovers(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for df in tables:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_ROWS, null_safe: bool = False) -> DataFrame:
    """Join against a table that is usually small; ``null_safe`` lets null keys meet.

    The small side is written once and counted; it is broadcast only when the
    count is within ``max_rows``. Past that it is an ordinary shuffled join,
    which adaptive execution splits where a key is skewed.
    """
    small = materialise(small)
    if small.count() <= max_rows:
        small = F.broadcast(small)
    return join_null_safe(big, small, on, how) if null_safe else big.join(small, on, how)


def join_null_safe(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join by columns of equal names in which a null meets a null; the left keys are kept."""
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__right_{c}"))
    return left.join(renamed, same, how).drop(*[f"__right_{c}" for c in on])


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect at most ``limit`` rows; more than that is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Use more cores for a scan that comes in only a few pieces.

    For plain file scans only. A scan of ``SPREAD_PIECES`` pieces or more is
    returned as it is however many cores there are, so nothing is shuffled
    where the data is large.
    """
    cores = min(scan.sparkSession.sparkContext.defaultParallelism, SPREAD_PIECES)
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)
