"""Vocabularies, ids and conversations of any size; arrays that stay aligned."""

import pytest
from pyspark.sql import functions as F

from tallymark.operators import chat, sequences, words
from tallymark.plans.proofs import contiguous_shard


@pytest.mark.parametrize("frequent", [1, 100_000])
def test_large_vocabulary_without_key(spark, monkeypatch, frequent):
    monkeypatch.setattr(sequences, "LOOKUP_WORDS", 2)
    monkeypatch.setattr(sequences, "BROADCAST_ROWS", frequent)
    docs = spark.createDataFrame([("b the a c",), ("the the",), (None,), ("c a",), ("c a",)], "text string")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, id int")
    got = sequences.tokenize(docs, vocab, keep=("text",))
    assert sorted((r.text or "", r.input_ids, r.attention_mask) for r in got.collect()) == [
        ("", [], []), ("b the a c", [2, 1, 3], [1, 1, 1]), ("c a", [3, 1], [1, 1]), ("c a", [3, 1], [1, 1]), ("the the", [], [])]


def test_seventy_thousand_words(spark):
    def letters(n):
        return F.concat(F.lit("w"), F.translate(F.conv(n.cast("string"), 10, 26), "0123456789", "QRSTUVWXYZ"))

    numbers = F.sequence(F.lit(0), F.lit(999))
    docs = spark.range(70).select(F.col("id").alias("doc_id"), F.array_join(
        F.transform(numbers, lambda i: letters(F.col("id") * 1000 + i)), " ").alias("text"))
    vocab = words.vocabulary(docs, k=100_000).cache()
    assert vocab.count() > 69_000
    got = sequences.tokenize(docs, vocab, keep=("doc_id",))
    assert got.agg(F.sum(F.size("input_ids"))).first()[0] == vocab.count()
    vocab.unpersist()


def test_hashed_ids_keep_their_order(spark):
    docs = spark.createDataFrame([(2**62, "cat dog"), (-5, "dog cat"), (7, "bird dog")], "doc_id bigint, text string")
    got = [(r.word, r.n) for r in words.top_words(words.word_counts(docs), 10).orderBy("rank").collect()]
    assert got == [("dog", 3), ("cat", 2), ("bird", 1)]
    assert [r.word for r in words.vocabulary(docs, k=2).orderBy("id").collect()] == ["dog", "cat"]


def test_a_conversation_is_one_row(spark):
    turns = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                    F.concat(F.lit("t"), F.col("id").cast("string")).alias("content"))
    row, = chat.conversation_blocks(turns).collect()
    assert [m.content for m in row.messages] == [f"t{i}" for i in range(300)]


def test_packed_arrays_stay_aligned(spark):
    rows = [(i, "s", list(range(i * 10, i * 10 + i)), [-x for x in range(i * 10, i * 10 + i)]) for i in range(9)]
    df = spark.createDataFrame(rows, "k bigint, shard string, ids array<int>, mask array<int>")
    got = sorted(sequences.pack(df, "ids", "shard", "k", 5, drop_tail=False, aligned=["mask"]).collect(), key=lambda r: r.chunk)
    assert [x for r in got for x in r.ids] == [x for _, _, ids, _ in rows for x in ids]
    assert all(r.mask == [-x for x in r.ids] for r in got) and [len(r.ids) for r in got] == [5] * 7 + [1]


@pytest.mark.parametrize(("n", "shards"), [(0, 3), (2, 3), (10, 3), (9, 3), (23, 8)])
def test_worker_shards_are_runs(spark, n, shards):
    got = [r[0] for r in spark.range(n).select(contiguous_shard(F.col("id"), F.lit(n), shards)).collect()]
    want = [s for s in range(shards) for _ in range(n // shards + (s < n % shards))]
    assert got == want
