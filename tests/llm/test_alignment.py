"""Token alignment beside a version with a dictionary of links."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymark.llm import alignment, bpe

tokenizers = pytest.importorskip("tokenizers")
BYTE, PIECE = bpe.public_vocabulary(), bpe.public_vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(BYTE, PIECE)


@pytest.fixture(scope="module")
def library():
    made = tokenizers.Tokenizer.from_file(BYTE)
    made.encode_special_tokens = True
    return made


def plain(both, library, text):
    """Ids, groups and links of one text, token by token."""
    a, b = library.encode(f" {text or ''}", add_special_tokens=False).ids, both.pieces.encode(text or "")
    whole = f" {text or ''}".encode()
    if not text or any(b"".join(t[i] for i in ids) != whole for t, ids in ((both.a_bytes, a), (both.b_bytes, b))):
        return [], [], [], Counter()
    groups, links, left, right, x, y, i, j = [], Counter(), [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y:
            left.append(a[i])
            x, i = x + len(both.a_bytes[a[i]]), i + 1
        else:
            right.append(b[j])
            y, j = y + len(both.b_bytes[b[j]]), j + 1
        if x == y and left and right:
            groups.append((left, right))
            links.update((p, q) for p in left for q in right)
            left, right = [], []
    return a, b, groups, links


def rows_of(both, library, docs):
    made = [(d, *plain(both, library, t)) for d, t in docs]
    held = Counter(p for *_, links in made for p in links)
    most: dict = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    for d, a, b, groups, links in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (d, len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]),
               sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("limits", [{}, {"POSTINGS": 50, "LISTED": 2}, {"PLACES": 2, "GROUP_CHARS": 10}])
def test_corpus(spark, edge, both, library, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(3)
    words = ["the", "cat's", "naïve", "schön", "<|endoftext|>", "<s>", "日本語", "😀", "1234", "  ", "\n", "x" * 2500, "▁", "\x00", "supercalifragilistic"]
    more = spark.createDataFrame([(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)],
                                 "doc_id bigint, text string")
    docs = edge.select("doc_id", "text", "score", "size").unionByName(more, allowMissingColumns=True).withColumn("n_a", edge.doc_id).repartition(4)
    got = alignment.align(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = rows_of(both, library, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_nothing(nothing):
    assert alignment.align(nothing).collect() == []


def test_counts_of_pairs(spark, both, library):
    texts = ["the cat sat", "the cat", "the the the cat", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.a, r.b): (r.docs, r.links) for r in alignment.pair_counts(alignment.index(docs, BYTE, PIECE)).collect()}
    links = [plain(both, library, t)[3] for t in texts]
    assert got == {p: (sum(p in x for x in links), sum(x[p] for x in links)) for p in set().union(*links)}


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_ids_of_any_text(both, library, text):
    assert both.byte_ids(text) == library.encode(text, add_special_tokens=False).ids
    assert [i for w in bpe.words(text) for i in both.vocabulary.merge(w.encode())] == both.byte_ids(text)


def test_split_agrees_on_every_code_point(both, library):
    for start in range(0, 0x110000, 1 << 12):
        chars = [chr(c) for c in range(start, start + (1 << 12)) if not 0xD800 <= c < 0xE000]
        text = "\n".join(f"a{c}1 {c}! b" for c in chars)
        assert both.byte_ids(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 299), st.integers(1, 9)), max_size=400))
def test_planes(rows):
    rows = sorted({(p, d): n for p, d, n in rows}.items())
    pair, place, count = (np.array(x, np.int64) for x in ([p for (p, _), _ in rows], [d for (_, d), _ in rows], [n for _, n in rows]))
    import pyarrow as pa
    start, planes = alignment.planes_of(pair, place, count, 300)
    found = {}
    for p, bits in zip(pair[start].tolist(), planes):
        at, weight = alignment.places_of(pa.array(bits, pa.binary()), 1 << np.arange(len(bits)))
        for d, w in zip(at.tolist(), weight.tolist()):
            found[p, d] = found.get((p, d), 0) + w
    assert found == dict(rows)
