"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source is one long stream of words: its documents permuted by hash, cut into
blocks of ``BLOCK_WORDS`` words. A target becomes an exact quota of
blocks. The quotas of all sources are handed down a binary tree over the
output shards: a node splits its blocks between its two halves by one
multivariate hypergeometric draw, so every shard gets its exact number of
blocks and a random share of every source, and the shards add up to the quotas.

A draw number of a source names an epoch and one block, by a permutation of the
source's blocks that every epoch seeds anew; shards own disjoint runs of draw
numbers. The permutation is the swap-or-not shuffle of Hoang, Morris and
Rogaway (2012): a few rounds of arithmetic, for any number of blocks. So no
block is sorted or sampled, and the blocks of a document follow from its place
in the stream. Only narrow rows
``(doc_id, source, size)`` are shuffled, into cells that no source dominates.
Per-source figures (words, targets, quotas) are the only thing the driver sees.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import materialise

#: Words of one block.
BLOCK_WORDS = 128
#: A source's words are taken at most so often.
MOST_EPOCHS = 3
#: Cells into which the documents of a source are dealt for their places.
CELLS = 4096
#: Rounds of a permutation.
ROUNDS = 24
#: Output shards of the mix.
SHARDS = 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column = "text") -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _source_key(source: str = "source") -> Column:
    """Sources as a never-null key in code point order, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))


def targets(sizes: DataFrame, weights: Column | None = None, most: float = MOST_EPOCHS) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source (``key, source_size``).

    Weights default to 1, 2, 3, repeating in key order. The sources share all
    words by weight; none gets more than ``most`` times its size, and what is
    above goes to the others by weight. Sorted by size per weight, the sources
    that stop at their limit come first, so two running sums settle it.
    """
    whole = Window.partitionBy()  # one row per source
    ranked = sizes.withColumn("weight", weights if weights is not None
                              else (F.pmod(F.row_number().over(whole.orderBy("key")) - 1, F.lit(3)) + 1).cast("double"))
    limit = F.col("source_size") * F.lit(float(most))
    before = whole.orderBy(limit / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levels = ranked.withColumn("level", level).withColumn("full", limit <= F.col("level") * F.col("weight"))
    # behind the full ones the level of the first source that is not full holds
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return levels.select(*ranked.columns, F.when(F.col("full"), limit).otherwise(shared * F.col("weight")).alias("target"))


def _grown(x: int, by: int) -> float:
    """``log((x + by)! / x!)``; for large ``x`` without the difference of two large logarithms."""
    y = x + by
    if min(x, y) < 1000:
        return math.lgamma(y + 1) - math.lgamma(x + 1)
    ends = [1 / (12 * z) - 1 / (360 * z**3) for z in (x, y)]
    return (x + 0.5) * math.log1p(by / x) + by * (math.log(y) - 1) + ends[1] - ends[0]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` items drawn from ``good`` and ``bad`` ones are good, for numbers of any size.

    Ratio of uniforms (Stadlober 1990): points of a rectangle that encloses the
    distribution, kept if they lie under it. Time does not depend on the sizes.
    """
    low, high, both = max(0, take - bad), min(good, take), good + bad
    if low == high:
        return low
    mean = take * (good / both)
    variance = mean * (bad / both) * ((both - take) / max(1, both - 1))
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(variance + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    top = min(max((take + 1) * (good + 1) // (both + 2), low), high)
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= x <= high:
            d = x - top
            if 2 * math.log(u) <= -(_grown(top, d) + _grown(good - top, -d) + _grown(take - top, -d) + _grown(bad - take + top, d)):
                return x


def _draw(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """Multivariate hypergeometric draw, one source after the other."""
    out, left, rest = np.zeros_like(counts), int(take), int(counts.sum())
    for i, n in enumerate(counts.tolist()):
        rest -= n
        out[i] = hypergeometric(rng, n, rest, left)
        left -= int(out[i])
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = 5) -> np.ndarray:
    """Blocks of every source in every shard: rows are shards, columns sources.

    Columns add up to the quotas; row totals differ by at most one.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    rng = np.random.default_rng(seed)

    def descend(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle, total = (low + high) // 2, int(counts.sum())
        # rows [0, i) of an even deal of the total hold its share rounded down, plus one for each of the first rows
        each, more = divmod(total, high - low)
        take = each * (middle - low) + min(more, middle - low)
        left = _draw(rng, counts, take)
        descend(left, low, middle)
        descend(counts - left, middle, high)

    if quotas:
        descend(np.array(quotas, np.int64), 0, shards)
    return out


def permuted(block: Column, blocks: Column, keys: Column) -> Column:
    """A permutation of ``0 .. blocks - 1``: each key pairs the blocks, and a hash bit of the pair tells whether its two change places."""
    def swap(x: Column, key: Column) -> Column:
        other = F.pmod(key - x, blocks)
        return F.when(F.xxhash64(F.greatest(x, other), key).bitwiseAND(1) == 1, other).otherwise(x)
    return F.aggregate(keys, block.cast("bigint"), swap)


def _places(rows: DataFrame) -> DataFrame:
    """Add ``start``: words before a document in its source's stream.

    Cells are dealt by hash, so a large source is spread over ``CELLS`` windows.
    """
    cells = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "key"), F.lit(CELLS)).cast("int"))
    totals = cells.groupBy("key", "cell").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("key").orderBy("cell")  # at most CELLS rows
    offsets = materialise(totals.select("key", "cell", (F.sum("words").over(over) - F.col("words")).alias("offset")))
    inside = Window.partitionBy("key", "cell").orderBy("doc_id", "size")
    placed = cells.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(offsets, ["key", "cell"]).withColumn("start", F.col("offset") + F.col("inside")).drop("cell", "inside", "offset")


def plan(docs: DataFrame, shards: int = SHARDS, seed: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents with their source's figures, and the mix.

    Documents: ``keep, key, size, source_size, target, start``, one row per row of
    ``docs``. The mix: ``doc_id, key, epoch, block, from_word, words, shard,
    place``: the piece of a document that a drawn block holds; a shard is read
    in the order of ``place``, which shuffles its blocks.
    """
    rows = materialise(docs.select(*keep, _source_key().alias("key"), n_words().alias("size")))
    sizes = materialise(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size"))))
    figures = sizes.orderBy("key").collect()  # one row per source of the mix
    blocks = [-(-r.source_size // BLOCK_WORDS) for r in figures]
    quotas = []
    for r, n in zip(figures, blocks):
        epochs = min(MOST_EPOCHS, int(r.target // r.source_size)) if r.source_size else 0
        rest = round((r.target - epochs * r.source_size) / BLOCK_WORDS) if epochs < MOST_EPOCHS else 0
        quotas.append(epochs * n + min(rest, n))
    table = split_quotas(quotas, shards, seed)
    ends = np.cumsum(table, axis=0)
    # equal keys modulo the blocks still have hash bits of their own
    keys = [np.random.default_rng([seed, i]).integers(0, 2**62, (MOST_EPOCHS, ROUNDS)).tolist() for i in range(len(blocks))]
    local = [(r.key, n, q, e, keys[i][e], [int(x) for x in ends[:, i]])
             for i, (r, n, q) in enumerate(zip(figures, blocks, quotas)) for e in range(-(-q // n) if n else 0)]
    epochs = docs.sparkSession.createDataFrame(
        local, "key string, blocks bigint, quota bigint, epoch int, keys array<bigint>, ends array<bigint>")
    places = materialise(_places(rows).join(F.broadcast(sizes.select("key", "source_size", "target")), "key"))
    block = F.explode(F.sequence(F.expr(f"start div {BLOCK_WORDS}"), F.expr(f"(start + size - 1) div {BLOCK_WORDS}")))
    pieces = (places.where("size > 0").join(F.broadcast(epochs), "key").withColumn("block", block)
              .withColumn("draw", F.col("epoch") * F.col("blocks") + permuted(F.col("block"), F.col("blocks"), F.col("keys")))
              .where("draw < quota"))
    first = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    mix = pieces.select(
        "doc_id", "key", "epoch", "block", (first - F.col("start")).alias("from_word"), (last - first).alias("words"),
        F.size(F.filter("ends", lambda e: e <= F.col("draw"))).alias("shard"),
        F.xxhash64("key", "draw", F.lit(seed)).alias("place"), "start", "size")
    return places, mix


def taken(docs: DataFrame, shards: int = SHARDS, seed: int = 5) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row.

    ``taken`` counts the words of the row's document that the mix holds, every
    epoch again. A text without words takes nothing. Rows that repeat each
    other have places of their own in the stream and are counted by them. A
    null source is a source of its own.
    """
    places, mix = plan(docs, shards, seed)
    got = mix.groupBy("key", "doc_id", "start", "size").agg(F.sum("words").alias("words"))
    p, g = places.alias("p"), got.alias("g")
    same = ((F.col("p.key") == F.col("g.key")) & F.col("p.doc_id").eqNullSafe(F.col("g.doc_id"))
            & (F.col("p.start") == F.col("g.start")) & (F.col("p.size") == F.col("g.size")))
    return p.join(g, same, "left").select("p.doc_id", "p.size", "p.source_size", "p.target",
                                          F.coalesce("g.words", F.lit(0)).cast("bigint").alias("taken"))


def in_mix(docs: DataFrame, shards: int = SHARDS, seed: int = 5) -> DataFrame:
    """``docs`` as the mix holds them, whole.

    A document whose words the mix takes n times comes n times, rounded; those
    of which it takes less than half are left out. Texts without words are not
    in a mix.
    """
    own = docs.withColumns({"__hash": F.xxhash64("text"), "__key": _source_key()})
    places, mix = plan(own, shards, seed, ("doc_id", "__hash"))
    got = mix.groupBy("key", "doc_id", "start", "size").agg(F.sum("words").alias("words"))
    p, g = places.alias("p"), got.alias("g")
    same = ((F.col("p.key") == F.col("g.key")) & F.col("p.doc_id").eqNullSafe(F.col("g.doc_id"))
            & (F.col("p.start") == F.col("g.start")) & (F.col("p.size") == F.col("g.size")))
    times = (p.join(g, same).groupBy("p.key", "p.doc_id", "p.__hash")
             .agg(F.round(F.sum("g.words") / F.sum("p.size")).cast("int").alias("__times")).where("__times > 0"))
    times = materialise(times.select(F.col("key").alias("__mix_key"), F.col("doc_id").alias("__mix_id"), F.col("__hash").alias("__mix_hash"), "__times"))
    here = (F.col("__key") == F.col("__mix_key")) & F.col("doc_id").eqNullSafe(F.col("__mix_id")) & (F.col("__hash") == F.col("__mix_hash"))
    return (own.join(times, here).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[f"`{c}`" for c in docs.columns]))
