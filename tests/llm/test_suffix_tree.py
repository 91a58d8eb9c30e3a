"""The suffix tree beside one kept in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tallymark.llm import suffix_tree

SF = "/root/testdata/sf0.001"


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


class Tree:
    """Brute force: all contexts in dictionaries."""

    def __init__(self, texts, depth, least, penalty=suffix_tree.PENALTY):
        self.words = Counter(w for t in texts for w in tokens_of(t))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.next = defaultdict(Counter)
        for t in texts:
            x = ["<s>", *tokens_of(t)]
            for i in range(1, len(x)):
                for k in range(1, min(depth, i) + 1):
                    self.next[tuple(x[i - k:i])][x[i]] += 1
        self.states, self.depth = {()}, depth
        for ctx in sorted(self.next, key=len):
            f = self.next[ctx]
            if sum(f.values()) < least or not {ctx[1:], ctx[:-1]} <= self.states:
                continue
            gain = sum(n * math.log(self.p(ctx, w) / self.p(ctx[1:], w)) for w, n in f.items())
            if gain > penalty * math.log(max(self.n, 2)) * (1 + sum(n > 1 for n in f.values())):
                self.states.add(ctx)

    def p(self, ctx, w):
        if not ctx:
            return (self.words[w] + 1) / (self.n + self.v + 1)
        f = self.next[ctx]
        c = sum(f.values())
        return max(f[w] - 1, 0) / c + len(f) / c * self.p(ctx[1:], w)

    def score(self, text):
        x, total, plain = ["<s>", *tokens_of(text)], 0.0, 0.0
        for i in range(1, len(x)):
            state = max((tuple(x[i - k:i]) for k in range(min(self.depth, i) + 1) if tuple(x[i - k:i]) in self.states), key=len)
            total += math.log10(self.p(state, x[i]))
            plain += math.log10(self.p((), x[i]))
        return plain, total


def check(docs, depth=3, least=suffix_tree.LEAST):
    rows = docs.select("doc_id", "text").collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tree = Tree([r.text for r in rows if not held(r.doc_id)], depth, least)
    model = suffix_tree.fit(docs, depth, least)
    lengths = Counter(map(len, tree.states))
    assert [n for n in model.states if n] == [lengths[k] for k in range(1, depth + 1) if lengths[k]]
    got = suffix_tree.score(docs, model, depth).collect()
    key = lambda d, n, known, s: (d is None, d or 0, n, known, round(s, 3))
    want = []
    for r in rows:
        t = tokens_of(r.text)
        want.append((key(r.doc_id, len(t), sum(w in tree.words for w in t), tree.score(r.text)[1]), tree.score(r.text), held(r.doc_id)))
    found = [(key(r.doc_id, r.n_tokens, r.n_known, r.score), (r.base_score, r.score), r.held_out) for r in got]
    for a, b in zip(sorted(want), sorted(found), strict=True):
        assert a[0][:4] == b[0][:4] and a[2] == b[2]
        assert b[1] == pytest.approx(a[1], rel=1e-7, abs=1e-4)
    assert {r.train_tokens for r in got} <= {tree.n}
    return tree, got


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_states_and_scores(spark):
    tree, got = check(spark.read.parquet(f"{SF}/documents.parquet").repartition(3), least=16)
    assert max(map(len, tree.states)) >= 2
    train = [r for r in got if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)


def test_rare_and_frequent_keys(spark, monkeypatch):
    rng = random.Random(12)
    table = {(a, b, c): rng.choice("uvw") for a in "uvw" for b in "uvw" for c in "uvw"}

    def text():
        x = [rng.choice("uvw") for _ in range(3)]
        for _ in range(rng.randint(0, 60)):
            x.append(table.get(tuple(x[-3:]), "u") if rng.random() < 0.8 else rng.choice(["u", "v", "w", f"rare{rng.randint(0, 400)}"]))
        return " ".join(x)

    docs = spark.createDataFrame([(i, text()) for i in range(150)], "doc_id bigint, text string").repartition(5)
    for hot, tokens, split in ((1, 500, 2), (20, 100, 10)):
        monkeypatch.setattr(suffix_tree, "HOT", hot)
        monkeypatch.setattr(suffix_tree, "TOKENS", tokens)
        monkeypatch.setattr(suffix_tree, "SPLIT", split)
        tree, _ = check(docs, least=8)
        assert max(map(len, tree.states)) == 3


def test_edge(spark, edge, nothing):
    check(edge, least=4)
    assert suffix_tree.score(nothing).count() == 0
    alone = suffix_tree.score(edge.where("doc_id = 1").withColumn("doc_id", edge.doc_id + 6)).collect()  # 7 is held out: nothing trains
    assert [(r.held_out, r.n_tokens, r.train_tokens, r.score) for r in alone] == [(zlib.crc32(b"7") % 7 == 2, 1, 0 if zlib.crc32(b"7") % 7 == 2 else 1, r.score) for r in alone]


def test_probabilities_add_up():
    tree = Tree(["a b a b a c", "a b c a b", "b a b a"] * 3, 2, 2)
    assert len(tree.states) > 1
    for state in tree.states:
        seen = sum(tree.p(state, w) for w in tree.words)
        assert seen + tree.p(state, "never seen") == pytest.approx(1)


def test_grams_stay_in_their_text():
    flat, sizes = suffix_tree.symbols(pa.array(["a b", None, "a b c"]))
    assert sizes.tolist() == [4, 2, 5]
    by_length = {n: every[ends] for n, ends, every in suffix_tree.grams(flat, sizes, 3)}
    assert [len(by_length[n]) for n in (1, 2, 3)] == [3 + 1 + 4, 3 + 1 + 4, 2 + 0 + 3]
    assert len(np.unique(by_length[2])) == 6  # begin a, a b, b end, begin end, b c, c end


def test_filter_holds_every_key(spark):
    keys = np.random.default_rng(1).integers(-2**63, 2**63, 1000)
    bits = suffix_tree.filter_of(spark.createDataFrame([(int(k),) for k in keys], "key bigint"))
    assert suffix_tree.in_filter(bits, keys.view(np.uint64)).all()
    assert suffix_tree.in_filter(bits, np.arange(10**5, dtype=np.uint64)).mean() < 0.01


def test_parts_and_codes_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(40)]
    texts = [" ".join(pool[min(39, int(rng.expovariate(0.2)))] for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", None]
    docs = spark.createDataFrame([*enumerate(texts), (None, "w1 w2 w3"), (5, "w1 w2")], "doc_id bigint, text string")
    found = []
    for rounds, codes in ((1, 1), (3, 1 << 16), (4, 16)):
        monkeypatch.setattr(suffix_tree, "ROUNDS", rounds)
        monkeypatch.setattr(suffix_tree, "ROUND_TOKENS", 16)
        monkeypatch.setattr(suffix_tree, "CODES", codes)
        made = suffix_tree.score(docs)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # what a part shuffled went with its end
        found.append(sorted(map(str, made.collect())))
    assert len(found[0]) == len(texts) + 2 and found[0] == found[1] == found[2]


def test_longer_grams_are_looked_up_only_where_both_parts_are_known(monkeypatch):
    flat, sizes = suffix_tree.symbols(pa.array(["a b c d", None, "x y a b c", "", "b c d e f g h", "a b"]))
    every = {n: keys[np.arange(len(flat)) if n == 1 else ends] for n, ends, keys in suffix_tree.grams(flat, sizes, 4)}
    model = np.unique(np.concatenate([every[1], *(k[np.isin(k, every[n][:m])] for n, k, m in ((2, every[2], 4), (3, every[3], 3), (4, every[4], 2)))]))
    looked_up = []
    monkeypatch.setattr(suffix_tree, "in_filter", lambda bits, keys: looked_up.append(len(keys)) or np.isin(keys, bits))
    found = {n: (ends, keys) for n, ends, keys in suffix_tree.known_grams(flat, sizes, 4, model)}
    for n, ends, keys in suffix_tree.grams(flat, sizes, 4):
        ends = np.arange(len(flat)) if n == 1 else ends
        ends = ends[np.isin(keys[ends], model)]
        assert found[n][0].tolist() == ends.tolist() and found[n][1].tolist() == keys[ends].tolist()
    assert looked_up[0] == len(flat) and len(found[4][0]) and all(m < len(every[n]) for n, m in zip((3, 4), looked_up[2:]))


def test_sums_and_orders():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 50, 400).astype(np.uint64) << np.uint64(40)
    unique, place, total, some = suffix_tree._add(keys, np.arange(400), keys > np.uint64(9 << 40))
    assert unique.tolist() == sorted(set(keys.tolist())) and (keys[place] == unique).all()
    assert total.tolist() == [int(np.arange(400)[keys == k].sum()) for k in unique]
    assert some.tolist() == [int((keys == k).sum()) if k > 9 << 40 else 0 for k in unique]
    assert (keys[suffix_tree._order(keys)] == np.sort(keys)).all()
    assert sorted(suffix_tree._order(keys >> np.uint64(40)).tolist()) == list(range(400))  # no leading bits to go by: every place, once
    owner = np.sort(rng.integers(0, 9, 40))
    assert suffix_tree._sums(owner, owner + 1, 10).tolist() == [int((owner[owner == k] + 1).sum()) for k in range(10)]
    assert [len(x) for x in suffix_tree._add(keys[:0], keys[:0])] == [0, 0, 0] and not len(suffix_tree._order(keys[:0]))


def test_keys_of_equal_leading_bits_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(30)]
    texts = [" ".join(pool[min(29, int(rng.expovariate(0.2)))] for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").coalesce(2)
    marks, plain = suffix_tree.mix(np.array([suffix_tree.BEGIN, suffix_tree.END])), suffix_tree.symbols
    words, low = plain(pa.array([" ".join(pool)]))[0], np.uint64(0xFFFFF)
    assert len(np.unique(words & low)) == len(words)

    def alike(column):
        flat, sizes = plain(column)
        return np.where(np.isin(flat, marks), flat, flat & low), sizes

    monkeypatch.setattr(suffix_tree, "HOT", 1)  # nothing is broadcast
    want = sorted(map(str, suffix_tree.score(docs).collect()))
    monkeypatch.setattr(suffix_tree, "symbols", alike)
    assert sorted(map(str, suffix_tree.score(docs).collect())) == want
