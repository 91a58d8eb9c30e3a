"""Token sequences: encoding, sub-word tokenizing, packing into chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.arrays import int_div
from tallymark.functions.batches import list_slices, text_slices
from tallymark.functions.text import STOP_WORDS, clean_tokens
from tallymark.operators.ordering import running_offset
from tallymark.session import BROADCAST_ROWS, materialise

LOOKUP_WORDS = 65_536
BITMAP_BITS = 1 << 22


def lookup_slots(entries: list) -> int:
    """About two slots per word, so that a slot's map stays little."""
    return 2 << len(entries).bit_length()


def lookup_table(entries: list) -> Column:
    """A small vocabulary as one constant: an array of little ``word -> id`` maps.

    A word's hash names its slot, so a lookup costs one array access.
    """
    slots = [{} for _ in range(lookup_slots(entries))]
    for row in entries:
        slots[row["hash"] % len(slots)][row["word"]] = row["id"]
    return F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<map<string,int>>")


def encode(df: DataFrame, vocab: DataFrame, text: str = "text", name: str = "input_ids", key: str | None = None) -> DataFrame:
    """Add the ids of the known words of every text, in order.

    A vocabulary of at most ``LOOKUP_WORDS`` words becomes a constant: one pass
    over the rows, nothing shuffled, and a text without known words keeps an
    empty list. A larger one is joined by ``key``, or without a key by a row
    number that is written down with the rows first.
    """
    entries = vocab.select("word", "id", F.hash("word").alias("hash")).limit(LOOKUP_WORDS + 1).collect()
    if len(entries) > LOOKUP_WORDS:
        if key is None:
            numbered = materialise(df.withColumn("__row", F.monotonically_increasing_id()))
            return encode_by_join(numbered, vocab, "__row", text, name).drop("__row")
        return encode_by_join(df, vocab, key, text, name)
    table, slots = lookup_table(entries), F.lit(lookup_slots(entries))
    ids = F.transform(clean_tokens(text), lambda word: F.try_element_at(F.get(table, F.pmod(F.hash(word), slots)), word))
    return df.withColumn(name, F.filter(ids, lambda i: i.isNotNull()))


def encode_by_join(df: DataFrame, vocab: DataFrame, key: str, text: str = "text", name: str = "input_ids") -> DataFrame:
    """As :func:`encode` for a vocabulary of any size; ``key`` is unique.

    Ids are ranks, so the words with low ids are the ones that fill the corpus.
    They are broadcast and looked up in the row, so their occurrences are never
    rows of their own. Of the other tokens those that are in no vocabulary,
    stop words above all, are left out where they are by a bitmap of the rare
    words' hashes, which has a fixed size; only what is left is joined by a
    shuffle, and its ids are put in at their places.
    """
    vocab = materialise(vocab.select("word", F.col("id").cast("int").alias("id")))
    frequent, others = vocab.where(F.col("id") <= BROADCAST_ROWS), vocab.where(F.col("id") > BROADCAST_ROWS)
    found = _found_in(frequent, set(STOP_WORDS) - {r.word for r in vocab.where(F.col("word").isin(STOP_WORDS)).collect()})(clean_tokens(text))
    if not others.limit(1).count():
        return df.withColumn(name, F.filter(found["ids"], lambda i: i.isNotNull()))
    rows = materialise(df.select(key, found.alias("__found")).select(key, "__found.*"))
    rest = rows.select(key, F.explode(F.arrays_zip("places", "words")).alias("r")).select(key, F.col("r.places").alias("pos"), F.col("r.words").alias("word"))
    rare = rest.where(_in_bitmap(others, F.col("word"))).join(others, "word").groupBy(key).agg(F.collect_list(F.struct("pos", "id")).alias("__rare"))
    out = df.join(rows.select(key, F.col("ids").alias("__ids")), key, "left").join(rare, key, "left")
    filled = F.arrow_udf(filled_ids, T.ArrayType(T.IntegerType()))
    return out.withColumn(name, filled("__ids", "__rare.pos", "__rare.id")).drop("__ids", "__rare")


def _found_in(frequent: DataFrame, absent: set[str]):
    """A function of arrays of tokens: each token's id, null where it is not among ``frequent``, and places and words of those.

    Empty tokens and those that are ``absent`` from the vocabulary have no place.
    """
    table = frequent.toArrow()  # at most BROADCAST_ROWS words
    known = [*table["word"].to_pylist(), *absent, ""]
    shared = frequent.sparkSession.sparkContext.broadcast((pa.array(known, pa.string()), pa.array(table["id"].to_pylist() + [None] * (len(absent) + 1), pa.int32())))

    @F.arrow_udf("ids array<int>, places array<int>, words array<string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, ids = shared.value
        for batch in batches:
            for tokens in list_slices(batch):
                flat, sizes = tokens.flatten(), pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
                at, edges = pc.index_in(flat, value_set=words), _edges(sizes)
                known, left = ids.take(at), at.is_null()
                at = np.flatnonzero(left.to_numpy(zero_copy_only=False))
                cuts = np.searchsorted(at, edges).astype("int32")
                places = (at - np.repeat(edges[:-1], np.diff(cuts))).astype("int32")
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(edges, known), pa.ListArray.from_arrays(cuts, pa.array(places)),
                                                  pa.ListArray.from_arrays(cuts, flat.filter(left))], names=["ids", "places", "words"])

    return found


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype("int32")


def filled_ids(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The ids in every list, with those of ``rare`` at their ``places``; what is null then is left out."""
    for ids, places, rare in batches:
        for part in list_slices(ids):
            more, part_rare = places.slice(part.offset - ids.offset, len(part)), rare.slice(part.offset - ids.offset, len(part))
            own, added = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (part, more))
            flat, edges = part.flatten(), _edges(own)
            values, known = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).copy(), flat.is_valid().to_numpy(zero_copy_only=False).copy()
            at = np.repeat(edges[:-1], added) + more.flatten().to_numpy(zero_copy_only=False).astype("int32")
            values[at], known[at] = part_rare.flatten().to_numpy(zero_copy_only=False), True
            yield pa.ListArray.from_arrays(np.searchsorted(np.flatnonzero(known), edges).astype("int32"), pa.array(values[known], pa.int32()))


def _in_bitmap(words: DataFrame, word: Column) -> Column:
    """Whether a word's hash is that of one of ``words``; false ones pass now and then, true ones always."""
    def bit(w):
        return F.pmod(F.xxhash64(w), F.lit(BITMAP_BITS))

    cells = words.groupBy(F.shiftright(bit(F.col("word")), 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit(F.col("word")) % 64).cast("int"))).alias("bits"))
    filled = dict(tuple(r) for r in cells.collect())  # BITMAP_BITS / 64 rows at most
    table = F.from_json(F.lit(json.dumps([filled.get(i, 0) for i in range(BITMAP_BITS // 64)])), "array<bigint>")
    return F.getbit(F.get(table, F.shiftright(bit(word), 6).cast("int")), (bit(word) % 64).cast("int")) == 1


def attention_mask(tokens: str = "input_ids") -> Column:
    """One 1 per token."""
    return F.array_repeat(F.lit(1), F.size(tokens))


def tokenize(df: DataFrame, vocab: DataFrame, text: str = "text", keep: tuple = ()) -> DataFrame:
    """``(keep..., input_ids, attention_mask)`` with a word vocabulary."""
    out = encode(df, vocab, text)
    return out.select(*keep, "input_ids", attention_mask().alias("attention_mask"))


def subword_ids(spec: str, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Ids of batches of texts, slice by slice: a token's encoding takes some hundred bytes."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(spec)
    for batch in batches:
        for texts in text_slices(batch.fillna("")):
            yield pd.Series([np.array(e.ids, dtype="int32") for e in model.encode_batch(texts.tolist())])


def tokenize_subwords(df: DataFrame, spec: str, text: str = "text", keep: tuple = ()) -> DataFrame:
    """``(keep..., input_ids, attention_mask)`` with a given sub-word tokenizer.

    ``spec`` is the JSON text of a saved tokenizer (vocabulary and merges), as
    the ``tokenizers`` package reads it.
    """
    json.loads(spec)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from subword_ids(spec, batches)

    out = df.withColumn("input_ids", ids(F.col(text)))
    return out.select(*keep, "input_ids", attention_mask().alias("attention_mask"))


def pack(df: DataFrame, tokens: str, shard: str, order: str, size: int = 1024, drop_tail: bool = True,
         bounds: dict | None = None, aligned: Sequence[str] = ()) -> DataFrame:
    """``(shard, chunk, tokens, aligned...)``: all sequences of a shard in a row, cut evenly.

    ``aligned`` are arrays with an entry for every token, such as the attention
    mask; they are cut where the tokens are.

    Every sequence is sliced where chunk borders fall on it, so slices travel
    and not tokens, and a chunk gathers at most ``size`` tokens. The short last
    chunk of a shard is dropped unless asked for.
    """
    arrays = [tokens, *aligned]
    placed = running_offset(df.select(shard, order, *arrays), order, F.size(tokens), [shard], "__at", bounds)
    begin, n = F.col("__at"), F.size(tokens)

    def piece(chunk):
        start = F.greatest(chunk * size, begin)
        length = F.least((chunk + 1) * size, begin + n) - start
        return F.struct(chunk.alias("chunk"), start.alias("start"),
                        *[F.slice(F.col(a), (start - begin + 1).cast("int"), length.cast("int")).alias(a) for a in arrays])

    spans = F.sequence(int_div(begin, size), int_div(begin + n - 1, size))
    pieces = placed.where(n > 0).select(shard, F.explode(F.transform(spans, piece)).alias("p"))
    chunks = pieces.groupBy(shard, F.col("p.chunk").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("p.start", *[f"p.{a}" for a in arrays]))).alias("parts"))
    out = chunks.select(shard, "chunk", *[F.flatten(F.col(f"parts.{a}")).alias(a) for a in arrays])
    return out.where(F.size(tokens) == size) if drop_tail else out
