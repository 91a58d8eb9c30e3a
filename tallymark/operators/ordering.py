"""Row positions, running offsets and position-based reading.

A position is a rank over an integer key, so it never depends on how the data
is partitioned. Ranks come from bucket totals: the key's high bits name a
bucket of at most ``2**LEAF_BITS`` keys, bucket totals are prefix-summed level
by level, and only the inside of one bucket is ordered by a window. No group
grows with the data, however rows are spread over ``within`` groups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.arrays import int_div
from tallymark.session import join_null_safe

LEAF_BITS = 10
FAN_BITS = 16


def key_bounds(df: DataFrame, keys: Sequence[str]) -> dict:
    """Row count and least and greatest value of every key: one row.

    A null key has no place in an order; it is an error.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for key in keys:
        aggs += [F.min(key).alias(f"lo_{key}"), F.max(key).alias(f"hi_{key}"), F.count(key).alias(f"n_{key}")]
    found = df.agg(*aggs).first().asDict()
    for key in keys:
        if found[f"n_{key}"] < found["n"]:
            raise ValueError(f"{found['n'] - found[f'n_{key}']} rows have a null {key!r} and so no position")
    return found


def _counts_without_gaps(df: DataFrame, key: str, bounds: dict) -> bool:
    """Whether the keys are exactly the numbers from the least to the greatest.

    As many keys as numbers, and the same sum of hashes: no key is missing or
    there twice.
    """
    lo, hi, n = bounds[f"lo_{key}"], bounds[f"hi_{key}"], bounds["n"]
    if n == 0:
        return True
    if hi - lo + 1 != n:
        return False

    def hashes(c):
        return F.sum((F.xxhash64(F.col(c).cast("bigint")) % (1 << 20)) + (F.xxhash64(F.col(c).cast("bigint"), F.lit(1)) % (1 << 20)) * (1 << 21))

    return df.agg(hashes(key)).first()[0] == df.sparkSession.range(lo, hi + 1).agg(hashes("id")).first()[0]


def _prefix_sums(totals: DataFrame, order: list[str], spans: list[int], within: list[str]) -> DataFrame:
    """Exclusive running sum of ``__w`` in the order of ``order`` within groups."""
    last, span = order[-1], spans[-1]
    if span <= 1 << FAN_BITS:
        parent, parent_spans, lifted = order[:-1], spans[:-1], totals
    else:
        up = f"__p{len(order)}_{last}"
        lifted = totals.withColumn(up, F.shiftright(last, FAN_BITS))
        parent, parent_spans = order[:-1] + [up], spans[:-1] + [(span >> FAN_BITS) + 1]
    groups = within + parent
    frame = Window.partitionBy(*groups).orderBy(last) if groups else Window.orderBy(last)
    inner = lifted.withColumn("__off", F.sum("__w").over(frame) - F.col("__w"))
    if not parent:
        return inner.drop("__w")
    above = _prefix_sums(lifted.groupBy(*groups).agg(F.sum("__w").alias("__w")), parent, parent_spans, within)
    above = above.select(*groups, F.col("__off").alias("__above"))
    out = join_null_safe(inner, above, groups).withColumn("__off", F.col("__off") + F.col("__above"))
    return out.select(*within, *order, "__off")


def running_offset(df: DataFrame, key: str | Sequence[str], weight: Column | None = None,
                   within: Sequence[str] = (), name: str = "offset", bounds: dict | None = None) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of the same group.

    ``key`` is one or more BIGINT columns that identify a row within a group;
    ``weight`` defaults to one per row. ``bounds`` saves the pass that reads
    the key range.
    """
    keys, within = ([key] if isinstance(key, str) else list(key)), list(within)
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    bounds = bounds or key_bounds(df, keys)
    spans = [(bounds[f"hi_{k}"] or 0) - (bounds[f"lo_{k}"] or 0) + 1 for k in keys[:-1]]
    lo, hi = bounds[f"lo_{keys[-1]}"] or 0, bounds[f"hi_{keys[-1]}"] or 0
    spans.append((hi >> LEAF_BITS) - (lo >> LEAF_BITS) + 1)

    bucket = within + keys[:-1] + ["__b"]
    rows = df.withColumn("__b", F.shiftright(F.col(keys[-1]).cast("bigint"), LEAF_BITS)).withColumn("__w", weight)
    totals = rows.groupBy(*bucket).agg(F.sum("__w").alias("__w"))
    offsets = _prefix_sums(totals, keys[:-1] + ["__b"], spans, within).select(*bucket, "__off")
    before = (Window.partitionBy(*bucket).orderBy(keys[-1])
              .rowsBetween(Window.unboundedPreceding, -1))
    inside = F.coalesce(F.sum("__w").over(before), F.lit(0))
    return join_null_safe(rows, offsets, bucket).withColumn(name, F.col("__off") + inside).drop("__b", "__w", "__off")


def with_row_index(df: DataFrame, key: str | Sequence[str], within: Sequence[str] = (),
                   name: str = "row_idx") -> DataFrame:
    """Add the dense position 0..n-1 of every row in key order.

    Rows of equal keys get positions of their own in no certain order; a null
    key is an error, a null group is a group. A single key that already counts
    without gaps only needs a subtraction; nothing is shuffled then.
    """
    keys = [key] if isinstance(key, str) else list(key)
    bounds = key_bounds(df, keys)
    if len(keys) == 1 and not within:
        lo = bounds[f"lo_{keys[0]}"]
        if _counts_without_gaps(df, keys[0], bounds):
            return df.withColumn(name, F.col(keys[0]).cast("bigint") - F.lit(lo or 0).cast("bigint"))
    return running_offset(df, keys, within=within, name=name, bounds=bounds)


def head(df: DataFrame, n: int, idx: str = "row_idx") -> DataFrame:
    """The first ``n`` rows by position."""
    return df.where(F.col(idx) < n)


def head_fraction(df: DataFrame, divisor: int, idx: str = "row_idx") -> DataFrame:
    """The first ``n // divisor`` rows by position, ``n`` being the row count."""
    n = df.agg(F.count(F.lit(1)).alias("n")).select(int_div("n", divisor)).scalar()
    return df.where(F.col(idx) < n)


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Only the named columns."""
    return df.select(*cols)


def concatenate(parts: Sequence[DataFrame], pos: str, name: str = "row_idx") -> DataFrame:
    """Append shards in the given order; positions restart from 0 over all rows."""
    tagged = [part.withColumn("shard_idx", F.lit(i).cast("bigint")) for i, part in enumerate(parts)]
    whole = tagged[0]
    for part in tagged[1:]:
        whole = whole.unionByName(part)
    return with_row_index(whole, ["shard_idx", pos], name=name)


def read_batches(df: DataFrame, size: int, drop_last: bool = False, idx: str = "row_idx") -> DataFrame:
    """Number the batches a sequential reader would see.

    Positions are dense, so the one short batch is known from the row count.
    """
    out = df.withColumn("batch_id", int_div(idx, size))
    if not drop_last:
        return out
    full = df.agg(F.count(F.lit(1)).alias("n")).select(int_div("n", size)).scalar()
    return out.where(F.col("batch_id") < full)


def keep_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Rows whose value is one of a fixed list."""
    return df.where(F.col(col).isin(list(values)))


def fill_missing(df: DataFrame, value: str = "Unknown", cols: Sequence[str] | None = None) -> DataFrame:
    """Replace nulls of string columns."""
    return df.fillna(value, subset=list(cols) if cols else None)


def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: str, batch_size: int | None = None,
                keep: Sequence[str] | None = None) -> DataFrame:
    """Apply a Python function to batches given as ``{column: list}``.

    The slow path: use it where no expression does the work. ``keep`` limits
    the columns that travel to Python; ``batch_size`` bounds a call, never
    which rows are seen.
    """

    def run(frames):
        for frame in frames:
            step = batch_size or max(len(frame), 1)
            for at in range(0, len(frame), step):
                part = frame.iloc[at:at + step]
                yield pd.DataFrame(fn({c: part[c].tolist() for c in part.columns}))

    return (df.select(*keep) if keep else df).mapInPandas(run, schema)
