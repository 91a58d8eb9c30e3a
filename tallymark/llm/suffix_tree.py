"""Scores of texts by a probabilistic suffix tree over words.

A state of the tree is a context of up to ``DEPTH`` words. Level by level, the
contexts that occur ``LEAST`` times and whose suffix and beginning are states are
tested: ``G`` adds up, over everything that follows the context, the log ratio of the
symbol's probability after the context and after its suffix. A context becomes
a state where ``G`` exceeds the description length of what it adds: ``PENALTY``
times the log of the number of training tokens, for the state and for each
follower it knows. Contexts that tell nothing new are dropped, and only
informative ones grow longer.

After a state with ``c`` occurrences, ``t`` different followers and a symbol
seen ``n`` times, the symbol's probability is ``(n - 1) / c + t / c * p`` with
``p`` that after the state's suffix; at the root it is ``(n + 1) / (N + V + 1)``.
As one is taken off every count, only followers seen twice need to be known
one by one, and ``G`` is that of followers the state has not seen before, not
of its own memory of them. Probabilities of all symbols and one unknown add up
to one in each state.

Each token is scored in its longest suffix state. The chain of log
probabilities along a state's suffixes telescopes into a sum over the n-grams
that end at the token, so a text's score is the sum of one number for each of
its n-grams: the model is a table ``key, value``, and scoring multiplies the
sparse matrix of texts and n-grams by it. Both sides are dealt into buckets by
key; n-grams in no row of the model are left out by a bitmap of fixed size, longer ones
without a look where one of their two parts was left out, and
keys with more than ``1 / HOT`` of the training tokens, fewer than ``HOT`` for
each length, are broadcast and never travel. The model is dealt out and packed
once; texts are scored in up to ``ROUNDS`` parts by ``doc_id``, one after the
other, and the shuffle files of a part go with its end. Sums are exact integers, so
reruns agree; rows are put in order within their partition, so that a task
that is run again numbers its documents as before.

Counts cover all training texts and all their tokens. Words are identified by
64-bit hashes; followers with more than ``1 / CODES`` of the training tokens
travel as numbers of 16 bits. Contexts that hold more than ``1 / SPLIT`` of the training
tokens are counted in many buckets.

Nulls, ties and odd rows: a null text is empty and has one token, its end. Rows
of one ``doc_id`` are rows like any other; a row without ``doc_id`` trains and is
not held out. Without training rows every token has the unknown's probability
1. Columns other than ``doc_id`` and ``text`` are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.batches import small_batches
from tallymark.llm.hashing import _BASE, mix, run_words, texts_of
from tallymark.session import discard, materialise

#: Longest context in words, occurrences a context needs for the test, and weight of the log in the test.
DEPTH, LEAST, PENALTY = 3, 64, 0.5
#: A key is broadcast above one in so many training tokens, a context split above one in so many.
HOT, SPLIT = 1 << 21, 1 << 12
#: Bits of a filter, tokens counted together, texts in a block, buckets at least and training tokens for each bucket.
FILTER_BITS, TOKENS, PLACES, BUCKETS, BUCKET_TOKENS = 1 << 27, 1_000_000, 1 << 16, 4096, 1 << 17
#: A follower travels as a 16-bit code above one in so many training tokens; parts in which texts are scored at most, and training tokens for each.
CODES, ROUNDS, ROUND_TOKENS = 1 << 16, 4, 1 << 22
#: Bytes of texts whose words are hashed in one step.
RUN = 1 << 16
#: Log probabilities are integers in units of 1 / UNIT.
UNIT = 1 << 32
BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4C2B2AE35)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each between a begin and an end mark, and the length of each with its marks."""
    data, offsets = texts_of(column)
    at, words, counts = 0, [np.zeros(0, np.uint64)], []
    while at < len(column):  # as many texts at once as come to RUN bytes, or one that is longer
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN, side="right")) - 1)
        found, n = run_words(data, offsets[at:upto + 1])
        words.append(found)
        counts.append(n)
        at = upto
    sizes = np.concatenate(counts) + 2 if counts else np.zeros(0, np.int64)
    flat = np.empty(int(sizes.sum()), np.uint64)
    last = np.cumsum(sizes) - 1
    flat[last - sizes + 1], flat[last] = BEGIN, END
    marks = np.zeros(len(flat), bool)
    marks[last - sizes + 1] = marks[last] = True
    flat[~marks] = np.concatenate(words)
    return mix(flat), sizes


def longer(keys: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Keys of the n-grams that are one symbol longer to the right."""
    return mix(keys * np.uint64(_BASE) + symbol)


def grams(flat: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length up to ``order``: the length, the n-grams' last places, and their keys at every place."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = flat
    for n in range(1, order + 1):
        if n > 1:
            keys = np.concatenate((keys[:1], longer(keys[:-1], flat[1:])))
        yield n, np.flatnonzero(place >= max(n - 1, 1)), keys


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(FILTER_BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def known_grams(flat: np.ndarray, sizes: np.ndarray, order: int, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length up to ``order``: the length, and last places and keys of the n-grams in the filter of a model; a begin mark counts as one.

    A model that has an n-gram also has it without its last and without its
    first symbol, so only where both of these were found a longer one is looked up.
    """
    begins = np.zeros(len(flat), bool)
    begins[np.cumsum(sizes) - sizes] = True
    ends, keys = np.arange(len(flat)), flat
    for n in range(1, order + 1):
        if n > 1:
            there = np.zeros(len(flat), bool)
            there[ends] = True
            there[begins] = False  # nothing ends there that goes on from the text before
            longest = there[np.minimum(ends + 1, len(flat) - 1)] & (ends + 1 < len(flat))
            ends = ends[longest] + 1
            keys = longer(keys[longest], flat[ends])
        among = in_filter(bits, keys)
        ends, keys = ends[among], keys[among]
        yield n, ends, keys


def filter_of(keys: DataFrame) -> np.ndarray:
    """Bits of the keys of a table, of a fixed size whatever the number of keys."""
    at = F.col("key").bitwiseAND(FILTER_BITS - 1)
    made = keys.select(F.shiftright(at, 15).alias("part"), (at % 32768).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in made.collect():  # at most FILTER_BITS bits
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _edges(*sorted_columns: np.ndarray) -> np.ndarray:
    """Places where any of the columns begins another value."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _add(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, a place of each, and sums of the values."""
    by = np.argsort(keys)
    keys = keys[by]
    edge = _edges(keys)
    if not len(edge):
        return keys, edge, *(np.zeros(0, np.int64) for _ in values)
    return keys[edge], by[edge], *(np.add.reduceat(x[by], edge, dtype=np.int64) for x in values)


def _order(x: np.ndarray) -> np.ndarray:
    """Places of numbers in the order of their leading bits.

    The others make room for the place, so numbers are sorted and not places,
    which is several times faster. Equal numbers adjoin but for those that share
    the leading bits with another.
    """
    bits = np.uint64(len(x).bit_length())
    return (np.sort((x >> bits << bits) | np.arange(len(x), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each of ``n`` owners, which are in ascending order."""
    total = np.concatenate(([0], np.cumsum(values)))
    return np.diff(total[np.searchsorted(owner, np.arange(n + 1))])


class Places:
    """Places of keys among sorted ones whose leading bits are even, as hashes are: a table of these bits leads close to each."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and the place of those that are."""
        at = self.start[keys >> self.shift]
        behind = np.flatnonzero(self.keys[at] < keys)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < keys[behind]]
        found = (self.keys[at] == keys) & (at < len(self.keys) - 1)
        return found, at[found]


def _joined(column: pa.Array, kind) -> np.ndarray:
    """The values of a binary column, one after the other, as numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else [0, 0]
    data = column.buffers()[2]
    low, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    return np.frombuffer(data, kind, size // np.dtype(kind).itemsize, low) if size else np.zeros(0, kind)


def _base(n: np.ndarray) -> np.ndarray:
    """Log10 of counts and one, in units."""
    return np.round(np.log10(n + 1.0) * UNIT).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64), pa.int64())


def _packed(values: np.ndarray, edges: list[int]) -> pa.Array:
    data, size = values.tobytes(), values.dtype.itemsize
    return pa.array([data[size * s:size * e] for s, e in zip(edges[:-1], edges[1:])], pa.binary())


# --- counting -----------------------------------------------------------------------------------


def count(texts: DataFrame, order: int, buckets: int, contexts=None, heavy: np.ndarray | None = None, often: np.ndarray | None = None) -> DataFrame:
    """Followers of all contexts of ``order - 1`` words that pass the filter ``contexts``, written once.

    Rows of order 1 are ``key, n``. Others are either followers seen twice or
    more (``ctx, key, parent, n``, and ``c, types`` of the context unless it is
    split) or, where ``key`` is null, sums over a context's followers in one
    bucket (``ctx, c, singles, types``). Followers among the words ``often``,
    fewer than ``CODES``, travel by their number.
    """
    often = np.sort(often) if often is not None else np.zeros(0, np.uint64)
    heavy = Places(np.sort(heavy) if heavy is not None else np.zeros(0, np.uint64))
    coded = np.concatenate((np.zeros(1, np.uint64), often))  # by number

    def partial(held: list[tuple[np.ndarray, ...]], frequent: Places):
        ctx, symbol, parent, key = (np.concatenate(x) for x in zip(*held))
        if order == 1:
            key = np.sort(key)
            edge = _edges(key)
            symbol = key[edge]
            bucket = (symbol >> np.uint64(20)) % np.uint64(buckets)
            leading = symbol
        else:
            by = _order(key)  # equal keys have equal parts, so any order of them will do; a key can come twice
            key = key[by]
            edge = _edges(key)
            first = by[edge]
            ctx, symbol, parent = ctx[first], symbol[first], parent[first] if order > 2 else parent
            bucket = (np.where(heavy.find(ctx)[0], key[edge], mix(ctx)) >> np.uint64(20)) % np.uint64(buckets)
            leading = ctx
        n, bits = np.diff(edge, append=len(key)), np.uint64(buckets.bit_length())
        by = _order((bucket << (np.uint64(64) - bits)) | (leading >> bits))
        bucket = bucket[by].astype(np.int64)
        edges = np.append(_edges(bucket), len(bucket)).tolist()
        symbol, code = symbol[by], np.zeros(len(by), np.uint16)
        common, at = frequent.find(symbol)
        code[common] = at + 1
        rest = np.concatenate(([0], np.cumsum(~common)))[edges].tolist()
        arrays = [pa.array(bucket[edges[:-1]], pa.int64()), _packed(ctx[by] if order > 1 else ctx, edges), _packed(code, edges), _packed(symbol[~common], rest),
                  _packed(parent[by] if order > 2 else parent, edges), _packed(n[by].astype(np.uint32), edges)]
        whole = pa.RecordBatch.from_arrays(arrays, names=["bucket", "ctx", "code", "symbol", "parent", "n"])
        for at in range(0, whole.num_rows, 512):
            yield whole.slice(at, 512)

    def run(batches: Iterator[pa.RecordBatch]):
        held, size, frequent, bits = [], 0, Places(often), contexts.value if order > 1 else None
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                flat, sizes = symbols(batch.column(0).slice(at, 100))
                for _, ends, before in grams(flat, sizes, max(order - 1, 1)):
                    pass
                if order == 1:
                    held.append((flat[:0], flat[:0], flat[:0], flat[ends]))
                else:  # a context is followed by what comes next in its text
                    last = np.zeros(len(flat), bool)
                    last[np.cumsum(sizes) - 1] = True
                    starts = np.flatnonzero(~last) if order == 2 else ends[~last[ends]]  # a begin mark is a context of one word
                    starts = starts[in_filter(bits, before[starts])]
                    ctx, ends = before[starts], starts + 1
                    symbol = flat[ends]
                    held.append((ctx, symbol, before[ends if order > 2 else ends[:0]], longer(ctx, symbol)))
                size += len(ends)
                if size >= TOKENS:
                    yield from partial(held, frequent)
                    held, size = [], 0
        if size:
            yield from partial(held, frequent)

    def merged(rows: list[dict]):
        ctx, rest, parent = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) for c in ("ctx", "symbol", "parent"))  # of order 1 without ctx
        code = np.concatenate([np.frombuffer(r["code"], np.uint16) for r in rows])
        symbol = coded[code]
        symbol[code == 0] = rest
        n = np.concatenate([np.frombuffer(r["n"], np.uint32) for r in rows]).astype(np.int64)
        key, first, n = _add(symbol if order == 1 else longer(ctx, symbol), n)
        if order == 1:
            return [pa.RecordBatch.from_arrays([_signed(key), pa.array(n)], names=["key", "n"])]
        ctx, parent, twice = ctx[first], (parent if order > 2 else symbol)[first], n > 1
        state, _, c, singles, again = _add(ctx, n, ~twice, n - 1)
        of, whole = np.searchsorted(state, ctx[twice]), ~heavy.find(state)[0]
        m, k, types = int(twice.sum()), len(state), c - again
        both = lambda left, right: pa.concat_arrays([left, right])
        none = lambda size: pa.nulls(size, pa.int64())
        arrays = [_signed(np.concatenate((ctx[twice], state))), both(_signed(key[twice]), none(k)), both(_signed(parent[twice]), none(k)),
                  both(pa.array(n[twice]), none(k)), *(both(pa.array(x[of], pa.int64(), mask=~whole[of]), pa.array(x)) for x in (c, types)),
                  both(none(m), pa.array(singles))]
        return [pa.RecordBatch.from_arrays(arrays, names=["ctx", "key", "parent", "n", "c", "types", "singles"])]

    def merge(batches: Iterator[pa.RecordBatch]):
        rows, bucket = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket and rows:
                    yield from merged(rows)
                    rows = []
                bucket = row["bucket"]
                rows.append(row)
        if rows:
            yield from merged(rows)

    parts = small_batches(texts).select("text").mapInArrow(run, "bucket bigint, ctx binary, code binary, symbol binary, parent binary, n binary")
    schema = "key bigint, n bigint" if order == 1 else "ctx bigint, key bigint, parent bigint, n bigint, c bigint, types bigint, singles bigint"
    return materialise(parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, schema))


# --- training -----------------------------------------------------------------------------------


def _log10(x: Column) -> Column:
    return F.round(F.log10(x) * UNIT).cast("bigint")


def _signed_int(x: np.uint64) -> int:
    return int(np.array([x], np.uint64).view(np.int64)[0])


class Model:
    """``values`` (``key, value, n, seen``), the training tokens and the different ones.

    A key can have several rows, all with one ``seen``; their values add up.
    ``tables`` are the stored ones that ``values`` reads.
    """

    def __init__(self, values: DataFrame, tokens: int, words: int, states: list[int], tables: list[DataFrame]):
        self.values, self.tokens, self.words, self.states, self.tables = values, tokens, words, states, tables

    @property
    def unit(self) -> float:
        """Log of the root's denominator."""
        return math.log10(self.tokens + self.words + 1)


def fit(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, penalty: float = PENALTY) -> Model:
    """Count the training texts and grow the tree; ``states`` of the model are their numbers by length."""
    spark = docs.sparkSession
    texts = docs.where(~held_out(F.col("doc_id"))).select("text")
    sizes = texts.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(BUCKETS, (sizes.bytes or 0) // 5 // BUCKET_TOKENS)
    unigrams = count(texts, 1, buckets)
    total = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    tokens, words = total.tokens, total.words
    end, begin = (_signed_int(mix(np.array([x]))[0]) for x in (END, BEGIN))
    # a key's part of the tree's log probabilities, its count if it is a word, and how often it is there
    values, states = [unigrams.select("key", F.lit(0).cast("bigint").alias("value"), "n", F.col("n").alias("seen"))], []
    known = unigrams.select("key", ((F.col("n") + 1) / (tokens + words + 1)).alias("p"))
    tables = [unigrams]
    often = np.array([r.key for r in unigrams.where(F.col("n") * CODES > tokens).select("key").collect()], np.int64).view(np.uint64)  # fewer than CODES
    starts = unigrams.where(F.col("key") == end).select(F.lit(begin).cast("bigint").alias("key"), "n")
    candidates = unigrams.where(F.col("key") != end).select("key", "n").union(starts).where(F.col("n") >= least)
    for order in range(2, depth + 2):
        candidates = materialise(candidates)
        if not candidates.take(1):
            break
        heavy = [r.key for r in candidates.where(F.col("n") * SPLIT > tokens).select("key").collect()]  # fewer than SPLIT
        shared = spark.sparkContext.broadcast(filter_of(candidates))
        counted = count(texts, order, buckets, shared, np.array(heavy, np.int64).view(np.uint64), often)
        shared.unpersist()
        tested = (counted.where("key IS NULL").groupBy("ctx").agg(*[F.sum(x).alias(x) for x in ("c", "types", "singles")])
                  .join(candidates.select(F.col("key").alias("ctx")), "ctx", "left_semi"))
        split = F.broadcast(tested.where(F.col("ctx").isin(heavy)).select("ctx", F.col("c").alias("c_"), F.col("types").alias("types_")))  # fewer than SPLIT
        follow = (counted.where("key IS NOT NULL").join(split, "ctx", "left").join(known.select(F.col("key").alias("parent"), F.col("p").alias("q")), "parent")
                  .withColumn("c", F.coalesce("c", "c_")).withColumn("rest", F.coalesce("types", "types_") / F.col("c"))
                  .withColumn("p", (F.col("n") - 1) / F.col("c") + F.col("rest") * F.col("q")).where(F.col("c") >= least))
        follow = materialise(follow.select("ctx", "key", "parent", "n", "p", "q", "rest"))
        gain = follow.groupBy("ctx").agg(F.sum(F.col("n") * F.log(F.col("p") / F.col("q"))).alias("gain"), F.count("*").alias("followers"))
        told = F.coalesce("gain", F.lit(0.0)) + F.col("singles") * F.log(F.col("types") / F.col("c"))
        length = penalty * math.log(max(tokens, 2)) * (1 + F.coalesce("followers", F.lit(0)))
        kept = materialise(tested.join(gain, "ctx", "left").where(told > length).select("ctx", "c", "types"))
        discard(counted, candidates)
        states.append(kept.count())
        if not states[-1]:
            break
        grown = follow.join(kept.select("ctx"), "ctx", "left_semi")
        grown = materialise(grown.select("key", "parent", "n", "p", _log10(F.col("p") / (F.col("q") * F.col("rest"))).alias("value")))
        discard(follow)
        tables += [grown, kept]
        nothing = F.lit(0).cast("bigint").alias("n")
        values += [grown.select("key", "value", nothing, F.col("n").alias("seen")),
                   kept.select(F.col("ctx").alias("key"), _log10(F.col("types") / F.col("c")).alias("value"), nothing, F.col("c").alias("seen"))]
        known = grown.select("key", "p")
        longest = grown.where(F.col("n") >= least).join(kept.select(F.col("ctx").alias("parent")), "parent", "left_semi")
        candidates = longest.select("key", "n")
    every = values[0]
    for more in values[1:]:
        every = every.union(more)
    return Model(every, tokens, words, states, tables)


# --- scoring ------------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model | None = None, depth: int = DEPTH) -> DataFrame:
    """Log10 probability of every text, by the model and by single words alone.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``; without ``model`` it is learned from ``docs``.
    """
    own, model = model is None, model or fit(docs, depth)
    spark = docs.sparkSession
    often = F.col("seen") * HOT > model.tokens
    hot = model.values.where(often).select("key", "value", "n").toArrow()  # fewer than HOT keys of each length
    keys, _, *sums = _add(hot["key"].to_numpy().view(np.uint64), hot["value"].to_numpy(), hot["n"].to_numpy())
    frequent = spark.sparkContext.broadcast((keys, *sums))
    held = spark.sparkContext.broadcast(filter_of(model.values))
    buckets = max(BUCKETS, model.tokens // BUCKET_TOKENS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = ["place", "doc_id", "held_out", "n_tokens", "value", "base", "known"]
    types = {"block": ("bigint", pa.int64()), "bucket": ("bigint", pa.int64()), "place": ("int", pa.int32()), "doc_id": (kind, None),
             "held_out": ("boolean", pa.bool_()), **{c: ("bigint", pa.int64()) for c in ("n_tokens", "value", "base", "known")},
             **{c: ("binary", pa.binary()) for c in ("keys", "sizes", "places", "times", "counts", "word_places", "word_times", "more", "more_places")}}
    ask = ["block", "bucket", *facts, "keys", "sizes", "places", "times"]
    back = ["block", *facts, "counts", "word_places", "word_times", "more", "more_places"]
    schema = lambda names: ", ".join(f"{c} {types[c][0]}" for c in names)

    def row(kind: pa.DataType, names: list[str], n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, types[c][1] or kind) for c in names], names=names)

    def requests(kind: pa.DataType, block: int, asked: list):
        key, place = (np.concatenate(x) for x in zip(*asked))
        bits = np.uint64(buckets.bit_length())
        rank = (key >> np.uint64(20)) % np.uint64(buckets) << (np.uint64(64) - bits)
        rank |= key >> (np.uint64(16) + bits) << np.uint64(16) | place.astype(np.uint64)  # by bucket, leading bits of the key, place
        by = np.argsort(rank)
        key, rank = key[by], rank[by]
        edge = _edges(key, rank)  # keys of equal leading bits can take turns: a key can come twice, and answers add up
        times, key, rank = np.diff(edge, append=len(key)), key[edge], rank[edge]
        place, first = rank.astype(np.uint16), _edges(key)
        sizes = np.diff(first, append=len(key))
        bucket = (rank[first] >> (np.uint64(64) - bits)).astype(np.int64)
        edges = np.append(_edges(bucket), len(bucket))
        cuts, n = np.append(first, len(key))[edges].tolist(), len(edges) - 1
        whole = row(kind, ask, n, block=pa.array(np.full(n, block), pa.int64()), bucket=pa.array(bucket[edges[:-1]], pa.int64()),
                    keys=_packed(key[first], edges.tolist()), sizes=_packed(sizes.astype(np.uint32), edges.tolist()),
                    places=_packed(place, cuts), times=_packed(times.astype(np.uint32), cuts))
        for at in range(0, n, 512):
            yield whole.slice(at, 512)

    def run(batches: Iterator[pa.RecordBatch]):
        task, blocks, n, asked = TaskContext.get().partitionId(), 0, 0, []
        size, (top, value, count), bits = 0, frequent.value, held.value
        base, top = _base(count), Places(top)
        whole, word = value + base, (count > 0).astype(np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                flat, sizes = symbols(part.column(2))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sums = np.zeros((3, len(sizes)), np.int64)
                for length, ends, mine in known_grams(flat, sizes, depth + 1, bits):
                    at = owner[ends]
                    found, hit = top.find(mine)
                    owners, rest = at[found], ~found
                    if length == 1:  # only words count for the base
                        sums[1] = _sums(owners, base[hit], len(sizes))
                        sums[2] = _sums(owners, word[hit], len(sizes))
                    sums[0] += _sums(owners, whole[hit], len(sizes))
                    asked.append((mine[rest], at[rest] + n))
                    size += len(mine) - len(owners)
                m, block = part.num_rows, (task << 32) | blocks
                yield row(part.column(0).type, ask, m, block=pa.array(np.full(m, block), pa.int64()),
                          bucket=pa.array(np.full(m, (task + blocks) % buckets), pa.int64()), place=pa.array(np.arange(n, n + m), pa.int32()),
                          doc_id=part.column(0), held_out=part.column(1), n_tokens=pa.array(sizes - 1), value=pa.array(sums[0]),
                          base=pa.array(sums[1]), known=pa.array(sums[2]))
                n += m
                if size >= TOKENS or n > PLACES - 100:
                    yield from requests(part.column(0).type, block, asked)
                    blocks, n, asked, size = blocks + 1, 0, [], 0
        if asked:
            yield from requests(part.column(0).type, (task << 32) | blocks, asked)

    def packed(values: pa.Table) -> pa.Table:
        known, _, value, n = _add(values["key"].to_numpy().view(np.uint64), values["value"].to_numpy(), values["n"].to_numpy())
        return pa.table({"of_bucket": values["of_bucket"].slice(0, 1), **{c: _packed(x, [0, len(x)]) for c, x in (("known", known), ("value", value), ("n", n))}})

    def answer(asked: pa.Table, values: pa.Table) -> pa.Table:
        asked, kind = asked.combine_chunks(), asked.schema.field("doc_id").type
        known, value, n = (_joined(values[c].combine_chunks(), t) for c, t in (("known", np.uint64), ("value", np.int64), ("n", np.int64)))
        rows = asked.filter(pa.compute.is_valid(asked["keys"])).select(["block", *ask[-4:]]).combine_chunks()
        columns = {c: [] for c in back if c not in facts}
        if len(known) and rows.num_rows:
            key, sizes, place, times = (_joined(rows[c].combine_chunks(), t) for c, t in zip(ask[-4:], (np.uint64, np.uint32, np.uint16, np.uint32)))
            asker = np.repeat(np.arange(rows.num_rows), pa.compute.binary_length(rows["keys"]).to_numpy() // 8)
            hit = np.minimum(np.searchsorted(known, key), len(known) - 1)
            found, hit, asker = (np.repeat(x, sizes) for x in (known[hit] == key, hit, asker))
            hit, place, times, asker = hit[found], place[found], times[found], asker[found]
            word, tree = n[hit] > 0, value[hit] != 0
            at, _, more = _add((asker[tree].astype(np.uint64) << np.uint64(16)) | place[tree], times[tree] * value[hit[tree]])
            edges = [np.searchsorted(x, np.arange(rows.num_rows + 1)).tolist() for x in (asker[word], at >> np.uint64(16))]
            columns = {"block": rows["block"].combine_chunks(), "counts": _packed(n[hit[word]].astype(np.uint64), edges[0]), "word_places": _packed(place[word], edges[0]),
                       "word_times": _packed(times[word], edges[0]), "more": _packed(more, edges[1]), "more_places": _packed((at & np.uint64(0xFFFF)).astype(np.uint16), edges[1])}
        texts = asked.filter(pa.compute.is_null(asked["keys"]))
        columns = {c: x if len(x) else pa.array([], types[c][1]) for c, x in columns.items()}
        return pa.Table.from_batches([row(kind, back, len(columns["block"]), **columns),
                                      row(kind, back, texts.num_rows, **{c: texts[c].combine_chunks() for c in ["block", *facts]})])

    def total(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        texts = rows.filter(pa.compute.is_valid(rows["place"]))
        place = texts["place"].to_numpy()
        value, base, known = np.zeros((3, len(place)), np.int64)
        told = rows.filter(pa.compute.is_null(rows["place"]))
        counts, at, times, more, more_at = (_joined(told[c].combine_chunks(), t) for c, t in zip(back[-5:], (np.uint64, np.uint16, np.uint32, np.int64, np.uint16)))
        times = times.astype(np.int64)
        np.add.at(base, at, _base(counts) * times)
        np.add.at(known, at, times)
        np.add.at(value, more_at, more)
        value, base, known = (texts[c].to_numpy() + x[place] for c, x in (("value", value + base), ("base", base), ("known", known)))
        n = texts["n_tokens"].to_numpy()
        score_of = lambda x: pa.array(x / UNIT - n * unit)
        return pa.Table.from_arrays([texts["doc_id"], texts["held_out"], texts["n_tokens"], pa.array(known), pa.array(np.full(len(n), tokens)),
                                     score_of(base), score_of(value)], names=order)

    order, tokens, unit = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], model.tokens, model.unit
    there = model.values.where(~often).select(F.pmod(F.shiftrightunsigned("key", 20), F.lit(buckets)).alias("of_bucket"), "key", "value", "n")
    there = materialise(there.groupBy("of_bucket").applyInArrow(packed, "of_bucket bigint, known binary, value binary, n binary"))
    if own:
        discard(*model.tables)
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    rounds, scored = min(ROUNDS, 1 + tokens // ROUND_TOKENS), None
    for at in range(rounds):
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == at)
        rows = part.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").sortWithinPartitions("doc_id", "text")
        asked = small_batches(rows).mapInArrow(run, schema(ask))
        answers = asked.groupBy("bucket").cogroup(there.groupBy("of_bucket")).applyInArrow(answer, schema(back))
        made = materialise(answers.groupBy("block").applyInArrow(total, out))
        scored = made if scored is None else scored.unionByName(made)
    discard(there)
    return scored
