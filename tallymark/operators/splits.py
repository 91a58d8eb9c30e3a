"""Repeatable random and stratified splits.

Rows are ordered by a seeded hash of their key and the first ones are the test
part. The cut is found from hash prefixes: counts per prefix give the one
prefix the cut falls into, and only rows of that prefix are ranked. The rows
themselves are then compared with the cut and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import join_small, materialise

PREFIX = 4


def split_hash(key: str, seed: int) -> Column:
    """Seeded hash that orders the rows of a split."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def _cut_hashes(df: DataFrame, key: str, strata: list[str], frac: float, seed: int) -> DataFrame:
    """Per stratum, the hash of the last test row (no row: no test part)."""
    hashed = df.select(*strata, split_hash(key, seed).alias("__h"))
    hashed = hashed.withColumn("__p", F.substring("__h", 1, PREFIX))
    counts = hashed.groupBy(*strata, "__p").agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    counts = (counts.withColumn("__end", F.sum("__c").over(whole.orderBy("__p")))
              .withColumn("__take", F.ceil(F.lit(frac) * F.sum("__c").over(whole))))
    cuts = (counts.where((F.col("__end") >= F.col("__take")) & (F.col("__end") - F.col("__c") < F.col("__take")))
            .select(*strata, "__p", (F.col("__take") - F.col("__end") + F.col("__c")).alias("__nth")))
    near = join_small(hashed, cuts, [*strata, "__p"], null_safe=True)
    rank = F.row_number().over(Window.partitionBy(*strata, "__p").orderBy("__h"))
    return near.withColumn("__r", rank).where(F.col("__r") == F.col("__nth")).select(*strata, F.col("__h").alias("__cut"))


def split_random(df: DataFrame, key: str, frac: float, seed: int = 0, name: str = "split") -> DataFrame:
    """Label ``ceil(frac * n)`` rows ``test`` and the others ``train``."""
    cut = materialise(_cut_hashes(df, key, [], frac, seed)).scalar()
    return df.withColumn(name, F.when(split_hash(key, seed) <= cut, "test").otherwise("train"))


def split_stratified(df: DataFrame, key: str, strata: Sequence[str], frac: float, seed: int = 0,
                     name: str = "split") -> DataFrame:
    """As :func:`split_random`, with the same share in every stratum.

    A null stratum is a stratum like any other.
    """
    cuts = _cut_hashes(df, key, list(strata), frac, seed)
    out = join_small(df, cuts, list(strata), "left", null_safe=True)
    return out.withColumn(name, F.when(split_hash(key, seed) <= F.col("__cut"), "test").otherwise("train")).drop("__cut")


def split_by_threshold(df: DataFrame, key: str, frac: float, seed: int = 0, name: str = "split") -> DataFrame:
    """One-pass split of about the asked share: the hash itself is compared."""
    edge = F.lit(format(min(int(frac * (1 << 32)), (1 << 32) - 1), "08x"))
    inside = F.substring(split_hash(key, seed), 1, 8) < edge
    return df.withColumn(name, F.when(inside, "test").otherwise("train"))
