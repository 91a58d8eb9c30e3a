"""Order-sensitive digests.

A chain starts at ``none`` and absorbs one row hash after the other. Rows are
chained in blocks of fixed size, block digests are chained the same way, and so
on until one is left, so no task ever holds more than one block. Chains of any
number of groups take the same passes as one chain.

The table of first blocks is what to store of a growing table: appended rows
carry on the last open block of their group, and only they are hashed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.arrays import int_div
from tallymark.functions.hashing import canonical_json
from tallymark.session import materialise

START = "none"


def _chain(items: Column, start: Column | None = None) -> Column:
    return F.aggregate(F.array_sort(items), F.lit(START) if start is None else start, lambda history, item: F.sha2(F.concat(item["h"], history), 256))


def _items(df: DataFrame, hashed: Column, idx: str, block: int, by: Sequence[str], weight: str | None = None) -> DataFrame:
    return df.select(*by, int_div(idx, block).alias("block_id"),
                     F.struct(F.col(idx).alias("i"), hashed.alias("h")).alias("item"),
                     (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("w"))


def chain_blocks(df: DataFrame, hashed: Column, idx: str, block: int = 1024, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., block_id, n, chain)``: the chain over each block of consecutive positions.

    ``n`` adds up ``weight``, one for each row by default.
    """
    rows = _items(df, hashed, idx, block, by, weight)
    return rows.groupBy(*by, "block_id").agg(F.sum("w").alias("n"), _chain(F.collect_list("item")).alias("chain"))


def extend_blocks(blocks: DataFrame, df: DataFrame, hashed: Column, idx: str, block: int = 1024, by: Sequence[str] = ()) -> DataFrame:
    """First blocks after more rows, whose positions go on behind those of ``blocks``; no old row is read.

    New rows that fall into a block that is open start from its chain, so the
    result equals ``chain_blocks`` over all rows. Appending no rows changes
    nothing; a position that a block already holds, or a gap within a block, is
    an error here, a gap that opens a new block one of ``chain_roots``.
    """
    keys = [*by, "block_id"]
    rows = _items(df, hashed, idx, block, by)
    fresh = rows.groupBy(*keys).agg(F.sum("w").alias("__n"), F.min("item.i").alias("__first"), F.max("item.i").alias("__last"),
                                    F.collect_list("item").alias("__items"))
    old = blocks.withColumnsRenamed({c: f"__old_{c}" for c in blocks.columns})
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__old_{c}"))
    both = fresh.join(old, same, "full")
    new, before = F.col("__n").isNotNull(), F.coalesce(F.col("__old_n"), F.lit(0))
    in_place = (F.col("__first") == F.col("block_id") * block + before) & (F.col("__last") == F.col("__first") + F.col("__n") - 1)
    items = F.when(in_place, F.col("__items")).otherwise(F.raise_error(F.lit("appended rows must follow the rows that are there")).cast("array<struct<i:bigint,h:string>>"))
    chain = F.when(new, _chain(items, F.coalesce(F.col("__old_chain"), F.lit(START)))).otherwise(F.col("__old_chain"))
    held = [F.when(new, F.col(c)).otherwise(F.col(f"__old_{c}")).alias(c) for c in keys]
    return both.select(*held, (before + F.coalesce(F.col("__n"), F.lit(0))).alias("n"), chain.alias("chain"))


def chain_roots(blocks: DataFrame, by: Sequence[str], block: int = 1024) -> DataFrame:
    """``(by..., n, levels, chain)`` of every group from its first blocks.

    One shuffle a level, each of ``block`` times fewer rows; a group that is
    down to one block keeps its chain on the levels that larger ones need.
    Missing blocks, and others than the last that are not full, are an error.
    """
    by = list(by)
    uneven = F.min(F.when(F.col("n") != block, F.col("block_id")))
    sizes = blocks.groupBy(*by).agg(F.max("block_id").alias("last"), (
        (F.count(F.lit(1)) != F.max("block_id") + 1) | (F.max("n") > block) | (uneven != F.max("block_id"))).alias("broken"))
    seen = sizes.agg(F.max("last").alias("last"), F.bool_or("broken").alias("broken")).first()
    if seen.broken:
        raise ValueError("positions are not dense from 0 in every group")
    left = (seen.last or 0) + 1
    level = blocks.select(*by, "block_id", "n", "chain", F.lit(1).alias("levels"))
    while left > 1:
        rows = level.select(*by, int_div("block_id", block).alias("__next"), "n", "levels", F.struct(F.col("block_id").alias("i"), F.col("chain").alias("h")).alias("item"))
        met = rows.groupBy(*by, "__next").agg(F.sum("n").alias("n"), F.max("levels").alias("levels"), F.collect_list("item").alias("items"))
        done = (F.col("__next") == 0) & (F.size("items") == 1)
        level = met.select(*by, F.col("__next").alias("block_id"), "n", F.when(done, F.get("items", F.lit(0))["h"]).otherwise(_chain(F.col("items"))).alias("chain"),
                           (F.col("levels") + F.when(done, 0).otherwise(1)).alias("levels"))
        left = -(-left // block)
    return level.select(*by, "n", "levels", "chain")


def chain_digests(df: DataFrame, cols: Sequence[str], idx: str, by: Sequence[str], block: int = 1024) -> DataFrame:
    """``(by..., n, levels, chain)`` of every group; positions are dense from 0 within a group.

    A null group is a group; no rows give no groups.
    """
    blocks = materialise(chain_blocks(df, F.sha2(canonical_json(list(cols)), 256), idx, block, by=by))
    return chain_roots(blocks, by, block)


def chain_digest(df: DataFrame, cols: Sequence[str], idx: str, block: int = 1024, n_rows: int | None = None) -> DataFrame:
    """One row ``(n, levels, chain)`` over rows with dense positions from 0."""
    n_rows = df.count() if n_rows is None else n_rows
    level = chain_blocks(df, F.sha2(canonical_json(list(cols)), 256), idx, block)
    left, levels = -(-n_rows // block), 1
    while left > 1:
        level = chain_blocks(level, F.col("chain"), "block_id", block, "n")
        left, levels = -(-left // block), levels + 1
    empty = F.coalesce(F.max("chain"), F.lit(START))
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit(levels).alias("levels"), empty.alias("chain"))
