"""N-gram join, sharding, mixing and fingerprints beside brute force."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import fingerprints, hashing, mixing, partenum, sharding


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(rows, size, num, den):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        out.append((d, len(sets[i]), min(known) if known else None))
    return Counter(out)


def near_copies(seed, groups, copies, words, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(text))
                text[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
                text = text or ["w"]
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "num", "seed"), [(3, 90, 1), (5, 80, 2), (1, 60, 3), (2, 50, 4)])
def test_components_are_those_of_all_pairs(spark, size, num, seed):
    rows = near_copies(seed, 40, 9, 60, 4) + near_copies(seed + 10, 40, 4, 8, 1)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = Counter(tuple(r) for r in partenum.components(docs, size, num, 100).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows, size, num, 100)


@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10), (1, 2)])
def test_linked_sets_share_a_signature(num, den):
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        most = (den - num) * 2 * len(a) // (den + num) + 2
        drop = int(rng.integers(0, min(len(a), most) + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, int(rng.integers(0, most + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if not len(b) or den * both < num * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        owner, sig = partenum.signature_rows([a, b], num, den)
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK_NODES", 4)
    rows = [(i, t) for i, (_, t) in enumerate(near_copies(5, 4, 30, 40, 4))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in partenum.components(docs, 3, 90, 100).collect())
    assert got == brute_components(rows, 3, 90, 100)


def test_joins_of_odd_rows(spark, edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in partenum.components(edge, 3, 90, 100).collect()) == brute_components(rows, 3, 90, 100)
    assert partenum.components(nothing).count() == 0
    kept = partenum.representatives(edge, 5, 80, 100)
    assert kept.columns == edge.columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    assert texts[(5, rows[5][1])] == 1 or texts[(5, "the same text here and there again")] == 1
    assert not [t for (d, t), n in texts.items() if t and t.lower() == "the same text here and there again" and d != 5]
    assert {d for d, t in texts if not (t or "").split()} == {0, 1, 2}
    assert partenum.representatives(nothing).count() == 0


def test_connected(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.label for r in partenum.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for link in links if link[0] != link[1] for x in link}


def test_word_hashes_follow_the_bytes():
    text = " Ab\tcd  ab\x0bÉé \x1c x\r\n".encode()
    hashes, start, end = hashing.word_spans(np.frombuffer(text, np.uint8))
    assert [text[a:b] for a, b in zip(start, end)] == text.split() and hashes[0] == hashes[2] and len(set(hashes.tolist())) == len(hashes) - 1
    assert len(hashing.word_hashes(np.zeros(0, np.uint8))) == 0


# --- sharding -----------------------------------------------------------------------------------


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > middle:
                used, load = used + 1, 0
            load += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_smallest_capacity(spark, seed):
    rng = random.Random(seed)
    groups = sorted((rng.randrange(2**63), rng.choice([1, 5, 40, 900 if seed % 2 else 30])) for _ in range(rng.choice([3, 40, 600])))
    if seed == 3:  # keys that agree in many leading bits
        groups = sorted({(k >> 20, s) for k, s in groups})
    shards = rng.choice([2, 5, 16])
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "key bigint, size bigint"), shards)
    assert capacity == brute_capacity([s for _, s in groups], shards) and cuts == sorted(cuts) and len(cuts) == shards - 1
    loads = Counter()
    for key, size in groups:
        loads[sum(key >= c for c in cuts)] += size
    assert max(loads.values()) <= capacity


def check_shards(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark, edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    check_shards(rows, sharding.assign(edge, 4).collect(), 4)
    assert sharding.assign(nothing, 4).count() == 0


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i % 37} " * (i % 5 + 1)) for i in range(400)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), 6).collect()
    check_shards(rows, got, 6)
    shard = {r.doc_id: r.shard for r in got}
    assert all(len({shard[i] for i, t in rows if t == text}) == 1 for _, text in rows)


# --- mixing -------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_sources = sum(sizes.values()), {}, list(order)
    while True:
        rest = total - sum(target.values())
        all_weight = sum(weight[s] for s in open_sources)
        over = [s for s in open_sources if rest * weight[s] / all_weight > 3 * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / all_weight for s in open_sources}
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_sources.remove(s)


def test_mix(spark):
    rng = random.Random(4)
    names = [None, "a", "b", "ä", "Z", "😀", "�"]
    rows = [(i, " \t".join(["w"] * rng.randint(0, 400)), names[min(rng.randrange(20), 6)]) for i in range(900)] + [(9999, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = {r.doc_id: r for r in mixing.taken(docs).collect()}
    again = {r.doc_id: r for r in mixing.taken(docs.repartition(2)).collect()}
    assert got == again and len(got) == len(rows)
    sizes, words = Counter(), Counter()
    for d, t, s in rows:
        sizes[s] += len((t or "").split())
        words[s] += got[d].taken
    want = brute_targets(sizes)
    for d, t, s in rows:
        r = got[d]
        assert r.size == len((t or "").split()) and r.source_size == sizes[s] and r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[s], rel=1e-9)
    assert all(abs(words[s] - want[s]) <= 2 * mixing.BLOCK_WORDS for s in sizes)


def test_mix_pieces_are_disjoint_and_shards_even(spark):
    rows = [(i, "w " * (i % 700), f"s{i % 4 if i % 3 else 0}") for i in range(300)]
    places, mix = mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shards=5)
    pieces = mix.collect()
    seen = Counter((r.doc_id, r.epoch, w) for r in pieces for w in range(r.from_word, r.from_word + r.words))
    assert max(seen.values()) == 1
    blocks = Counter(r.shard for r in {(r.key, r.epoch, r.block): r for r in pieces}.values())
    assert max(blocks.values()) - min(blocks.values()) <= 1 and set(blocks) == set(range(5))


def test_splitting_tree():
    table = mixing.split_quotas([7, 0, 100, 3], 6)
    assert table.sum(axis=0).tolist() == [7, 0, 100, 3] and table.sum(axis=1).max() - table.sum(axis=1).min() <= 1
    huge = mixing.split_quotas([4 * 10**9, 10**9 + 7], 3)
    assert huge.sum(axis=0).tolist() == [4 * 10**9, 10**9 + 7] and (huge >= 0).all()
    draws = np.array([mixing.split_quotas([30, 70], 2, seed)[0] for seed in range(400)])
    assert draws.sum(axis=1).tolist() == [50] * 400 and abs(draws[:, 0].mean() - 15) < 0.5
    assert mixing.split_quotas([], 3).shape == (3, 0)


def test_hypergeometric_draws_follow_the_distribution():
    rng = np.random.default_rng(1)
    good, bad, take = 12, 20, 9
    got = np.bincount([mixing.hypergeometric(rng, good, bad, take) for _ in range(20_000)], minlength=10) / 20_000
    want = np.array([math.comb(good, k) * math.comb(bad, take - k) for k in range(10)]) / math.comb(good + bad, take)
    assert np.abs(got - want).max() < 0.015
    assert [mixing.hypergeometric(rng, *x) for x in ((0, 5, 3), (5, 0, 3), (5, 5, 0), (5, 5, 10))] == [0, 3, 0, 5]
    good, bad, take = 3 * 10**12, 10**12, 2 * 10**12  # far beyond numpy's generator
    draws = np.array([mixing.hypergeometric(rng, good, bad, take) for _ in range(2000)], float)
    spread = math.sqrt(take * 0.75 * 0.25 * (good + bad - take) / (good + bad - 1))
    assert abs(draws.mean() - take * 0.75) < 5 * spread / math.sqrt(2000) and abs(draws.std() / spread - 1) < 0.08


def test_blocks_are_permuted_and_not_rotated(spark):
    keys = F.array(*[F.lit(k) for k in np.random.default_rng(2).integers(0, 2**62, mixing.ROUNDS).tolist()])
    for n in (1, 2, 7, 1000):
        blocks = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), keys).alias("draw")).orderBy("id").collect()
        draws = [r.draw for r in blocks]
        assert sorted(draws) == list(range(n))
    assert sum(abs(a - b) == 1 for a, b in zip(draws, draws[1:])) < 12  # two of a thousand are expected by chance
    assert abs(np.corrcoef(draws, range(n))[0, 1]) < 0.12


def test_mix_of_odd_rows(edge, nothing):
    got = mixing.taken(edge).collect()
    assert len(got) == edge.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.taken(nothing).count() == 0
    kept = mixing.in_mix(edge)
    assert kept.columns == edge.columns and kept.where("text is null").count() == 0
    assert mixing.in_mix(nothing).count() == 0


# --- fingerprints -------------------------------------------------------------------------------


def piece_set(text):
    return set(fingerprints.pieces(np.frombuffer(text.encode(), np.uint8)).tolist())


def check_fingerprints(rows, got):
    order = sorted(rows, key=lambda r: r[0])
    found = {r.doc_id: r for r in got}
    for i, (d, text) in enumerate(order):
        following, half = order[(i + 1) % len(order)][1] or "", len(text or "") // 2
        text = text or ""
        edited = text[:len(text) - half] + following[:half]
        r = found[d]
        a, b, c = piece_set(text), piece_set(edited), piece_set(following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        like = lambda x, y: 1 - len(x ^ y) / (len(x) + len(y)) if x or y else 1.0
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
        assert (r.removed, r.added) == (len(a - b), len(b - a))
        assert r.fingerprint == fingerprints.to_text(fingerprints.pieces(np.frombuffer(text.encode(), np.uint8)))
        assert len(base64.b64decode(r.fingerprint)) == 16 * fingerprints.CELLS


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_fingerprints(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randrange(10**12) if i % 2 else i, " ".join(rng.choice(["a", "b", "longer\nline", "é😀", f"w{rng.randrange(99)}"])
             for _ in range(rng.randint(0, 200)))) for i in range(90)]
    rows.append((-5, None))
    rows = list(dict(rows).items())
    check_fingerprints(rows, fingerprints.compare_with_edits(spark.createDataFrame(rows, "doc_id bigint, text string"), parts).collect())


def test_fingerprints_of_odd_rows(spark, edge, nothing):
    assert fingerprints.compare_with_edits(edge, 3).count() == edge.count()
    assert fingerprints.compare_with_edits(nothing, 3).count() == 0
    one = spark.createDataFrame([(1, "just one text of some words")], "doc_id bigint, text string")
    assert [r.near_next for r in fingerprints.compare_with_edits(one).collect()] == [1.0]


def test_peeling_recovers_differences():
    rng = np.random.default_rng(2)
    pairs = []
    for _ in range(60):
        common, a, b = (np.unique(rng.integers(0, 2**63, int(rng.integers(0, 300)), dtype=np.uint64)) for _ in range(3))
        pairs.append((np.unique(np.concatenate((common, a))), np.unique(np.concatenate((common, b)))))
    for (a, b), (only_a, only_b) in zip(pairs, fingerprints.differences(pairs)):
        assert set(only_a.tolist()) == set(a.tolist()) - set(b.tolist()) and set(only_b.tolist()) == set(b.tolist()) - set(a.tolist())
    assert any(found is None for found in fingerprints.peel(pairs, fingerprints.CELLS))  # a small sketch stalls


def test_fingerprints_are_of_exact_bytes_and_repeats():
    def likeness(a, b):
        a, b = ({int(x) for x in fingerprints.pieces(np.frombuffer(t.encode(), np.uint8))} for t in (a, b))
        return len(a & b) / len(a | b)

    text = "Alpha Beta\nGamma  delta\nx\n"
    for other in ("alpha Beta\nGamma  delta\nx\n", "Alpha Beta\nGamma delta\nx\n", "Alpha Beta\n\nGamma  delta\nx\n", text + "x\n", text[:-1]):
        assert 0 < likeness(text, other) < 1
    # lines without a cut inside: the digests are as many as lines, and shared as often as both have a line
    lines = [s for s in (f"l{i}" for i in range(300)) if len(fingerprints.pieces(np.frombuffer(f"{s}\n".encode(), np.uint8))) == 1][:20]
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice(lines) for _ in range(rng.randint(1, 40))] for _ in range(2))
        both, either = Counter(a) & Counter(b), Counter(a) | Counter(b)
        assert likeness("".join(f"{x}\n" for x in a), "".join(f"{x}\n" for x in b)) == both.total() / either.total()
