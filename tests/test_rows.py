"""Positions, offsets, splits, chains."""

import hashlib
import json
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallymark.functions.hashing import canonical_json
from tallymark.operators import chain, ordering, splits, workers


@pytest.fixture
def tiny_buckets(monkeypatch):
    """Small buckets, so that every level of the prefix sums is used."""
    monkeypatch.setattr(ordering, "LEAF_BITS", 2)
    monkeypatch.setattr(ordering, "FAN_BITS", 9)


@pytest.fixture(scope="session")
def keyed(spark):
    rows = [(k, k % 7 if k % 3 else 0, (k * k) % 11) for k in [*range(-40, 200, 3), 10**6, 10**12, 2**61, -(2**60)]]
    return spark.createDataFrame(rows, "k bigint, g bigint, w bigint").repartition(5)


def test_row_index(spark, keyed, tiny_buckets):
    got = {r.k: r.row_idx for r in ordering.with_row_index(keyed, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def test_row_index_of_gapless_key_does_not_shuffle(spark):
    df = ordering.with_row_index(spark.range(5, 500), "id")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.orderBy("id").limit(2).collect()] == [(5, 0), (6, 1)]
    assert ordering.with_row_index(spark.range(0), "id").count() == 0


def test_running_offset_within_groups(spark, keyed, tiny_buckets):
    rows = ordering.running_offset(keyed, "k", F.col("w"), ["g"]).collect()
    seen = defaultdict(int)
    for r in sorted(rows, key=lambda r: r.k):
        assert r.offset == seen[r.g]
        seen[r.g] += r.w
    assert len(rows) == keyed.count()


def test_row_index_by_two_keys(spark, keyed, tiny_buckets):
    rows = ordering.with_row_index(keyed, ["w", "k"]).collect()
    assert [r.row_idx for r in sorted(rows, key=lambda r: (r.w, r.k))] == list(range(len(rows)))


def test_running_offset_has_no_whole_group_window(spark):
    df = spark.range(0, 10**6, 2).withColumn("g", F.lit(1))
    plan = ordering.running_offset(df, "id", within=["g"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__b" in line for line in windows)


def test_heads_and_batches(spark):
    df = ordering.with_row_index(spark.range(0, 100, 3), "id")
    assert ordering.head(df, 5).count() == 5
    assert ordering.head_fraction(df, 10).count() == 3
    sizes = Counter(r.batch_id for r in ordering.read_batches(df, 8).collect())
    assert sorted(sizes.values()) == [2, 8, 8, 8, 8]
    assert set(Counter(r.batch_id for r in ordering.read_batches(df, 8, drop_last=True).collect()).values()) == {8}


def test_concatenate(spark):
    a, b = spark.range(3).toDF("p"), spark.range(2).toDF("p")
    rows = sorted(ordering.concatenate([b, a], "p").collect(), key=lambda r: r.row_idx)
    assert [(r.shard_idx, r.p) for r in rows] == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    assert [r.row_idx for r in rows] == list(range(5))


def test_map_batches_sees_every_row(spark):
    got = ordering.map_batches(spark.range(25), lambda b: {"id": [2 * i for i in b["id"]]}, "id bigint", batch_size=4)
    assert sorted(r.id for r in got.collect()) == list(range(0, 50, 2))


def order(seed, keys):
    return sorted(keys, key=lambda k: hashlib.sha256(f"{seed}:{k}".encode()).hexdigest())


@pytest.mark.parametrize("frac", [0.0, 0.0015, 0.3, 1.0])
def test_random_split(spark, frac):
    got = {r.id for r in splits.split_random(spark.range(1000), "id", frac, seed=3).where("split = 'test'").collect()}
    assert got == set(order(3, range(1000))[:math.ceil(frac * 1000)])


def test_split_does_not_depend_on_partitions(spark):
    a = splits.split_random(spark.range(200).repartition(1), "id", 0.2).where("split = 'test'").collect()
    b = splits.split_random(spark.range(200).repartition(9), "id", 0.2).where("split = 'test'").collect()
    assert sorted(a) == sorted(b) and len(a) == 40


def test_stratified_split_with_hot_stratum(spark):
    df = spark.range(600).withColumn("s", F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 7))
    rows = splits.split_stratified(df, "id", ["s"], 0.25, seed=1).collect()
    for s in {r.s for r in rows}:
        keys = [r.id for r in rows if r.s == s]
        test = {r.id for r in rows if r.s == s and r.split == "test"}
        assert test == set(order(1, keys)[:math.ceil(0.25 * len(keys))])
    assert len(rows) == 600


def test_threshold_split(spark):
    share = splits.split_by_threshold(spark.range(4000), "id", 0.25).where("split = 'test'").count() / 4000
    assert abs(share - 0.25) < 0.03


def plain_chain(hashes, block):
    while True:
        out = []
        for i in range(0, len(hashes), block):
            history = "none"
            for h in hashes[i:i + block]:
                history = hashlib.sha256((h + history).encode()).hexdigest()
            out.append(history)
        if len(out) <= 1:
            return out[0] if out else "none"
        hashes = out


@pytest.mark.parametrize("n,block", [(0, 4), (1, 4), (4, 4), (5, 4), (70, 4)])
def test_chain(spark, n, block):
    df = spark.range(n).repartition(3).withColumn("t", F.col("id").cast("string"))
    hashes = [hashlib.sha256(json.dumps({"t": str(i)}, separators=(",", ":")).encode()).hexdigest() for i in range(n)]
    got = chain.chain_digest(df, ["t"], "id", block).first()
    assert (got.n, got.chain) == (n, plain_chain(hashes, block))


def test_equal_chains_are_equal_multisets_but_order_matters(spark):
    from tallymark.operators.multiset import multiset_equal

    a = spark.createDataFrame([(0, "x"), (1, "y")], "i bigint, t string")
    b = spark.createDataFrame([(0, "y"), (1, "x")], "i bigint, t string")
    assert chain.chain_digest(a, ["t"], "i").first() == chain.chain_digest(a.repartition(2), ["t"], "i").first()
    assert multiset_equal(a, b, ["t"]).first().equal
    assert chain.chain_digest(a, ["t"], "i").first() != chain.chain_digest(b, ["t"], "i").first()


@pytest.mark.parametrize("block", [2, 4])
def test_chains_of_groups_and_of_appended_rows(spark, block):
    sizes = {"a": 1, "b": 4, "c": 5, None: 17, "d": 64}
    rows = [(k, i, f"{k}{i}") for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i bigint, t string").repartition(5)
    expected = {k: (n, plain_chain([hashlib.sha256(json.dumps({"t": f"{k}{i}"}, separators=(",", ":")).encode()).hexdigest() for i in range(n)], block))
                for k, n in sizes.items()}
    found = chain.chain_digests(df, ["t"], "i", ["k"], block)
    assert {r.k: (r.n, r.chain) for r in found.collect()} == expected
    for k in sizes:  # alone, a group has the same chain and as many levels
        own = df.where(F.col("k").eqNullSafe(F.lit(k)))
        alone, among = chain.chain_digest(own, ["t"], "i", block).first(), found.where(F.col("k").eqNullSafe(F.lit(k))).first()
        assert (alone.n, alone.levels, alone.chain) == (among.n, among.levels, among.chain)
    hashed = F.sha2(canonical_json(["t"]), 256)
    blocks = chain.chain_blocks(df.where("i < 3"), hashed, "i", block, by=["k"])
    for part in ("i between 3 and 9", "i < 0", "i > 9"):
        blocks = chain.extend_blocks(blocks, df.where(part), hashed, "i", block, ["k"])
    assert {r.k: (r.n, r.chain) for r in chain.chain_roots(blocks, ["k"], block).collect()} == expected
    assert chain.chain_digests(df.where("false"), ["t"], "i", ["k"], block).count() == 0


@pytest.mark.parametrize("part", ["i = 2", "i = 4", "i = 6", "i > 7"])
def test_rows_that_do_not_follow_are_not_appended(spark, part):
    df = spark.range(9).selectExpr("id i", "string(id) t")
    hashed = F.sha2("t", 256)
    blocks = chain.chain_blocks(df.where("i < 3"), hashed, "i", 4)
    with pytest.raises(Exception, match="must follow|not dense"):
        chain.chain_roots(chain.extend_blocks(blocks, df.where(part), hashed, "i", 4), [], 4).collect()


def test_worker_function_leaves_rows_and_states(spark):
    import pyarrow as pa

    def doubled(batches):
        seen = []
        for batch in batches:
            ids = batch.column("id").to_pylist()
            seen += ids
            yield pa.RecordBatch.from_pydict({"twice": [2 * i for i in ids], "id": ids})
        return {"n": len(seen), "ids": seen}

    for n in (0, 100):
        rows, states = workers.map_with_state(spark.range(n).repartition(4), doubled, "id bigint, twice int", "n bigint, ids array<bigint>, more string")
        assert sorted((r.id, r.twice) for r in rows.collect()) == [(i, 2 * i) for i in range(n)]
        got = states.collect()
        assert sorted(i for r in got for i in r.ids) == list(range(n)) and sum(r.n for r in got) == n
        assert got and all(r.more is None for r in got)


def test_python_json_leaves_in_slices():
    import json

    import pyarrow as pa

    from tallymark.functions.batches import SLICE_CHARS
    from tallymark.functions.hashing import rendered_json

    rows = [{"text": "ü" * 1000, "n": i} for i in range(500)] + [{"text": "x" * 3 * SLICE_CHARS}, {"text": None}]
    given = pa.array([json.dumps(r, ensure_ascii=False) for r in rows], pa.string())
    made = list(rendered_json(given))
    assert [text for part in made for text in part.to_pylist()] == [json.dumps(r) for r in rows]
    assert max(len(part) for part in made) <= SLICE_CHARS // 2000 + 2
    assert list(rendered_json(given[:0])) == []
