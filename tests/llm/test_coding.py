"""Byte-pair coding beside the tokenizers library."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymark.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.public_vocabulary()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def same(library, coder, texts):
    for text, (ids, decoded) in zip(texts, coder.encode(texts)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == ",".join(map(str, want))
        assert decoded == library.decode(want, skip_special_tokens=False)
        assert coder.decode(want) == decoded


def test_pools_of_odd_characters(library, vocabulary):
    pool = ["a", "b", " ", "  ", "\n", "'s", "'LL", "é", "1", "٣", "½", "😀", "<|endoftext|>", "　", "\xa0", "\x1c", "\x85", "한", "!", "...",
            "ß", "Ɤ", "\U000105c1", "\U00010d41"]
    rng = random.Random(1)
    same(library, bpe.Coder(vocabulary), ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(2000)])


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(library, vocabulary, text):
    same(library, bpe.Coder(vocabulary), [text])


def test_split_agrees_on_every_code_point(library):
    for start in range(0, 0x110000, 1 << 12):
        chars = [chr(c) for c in range(start, start + (1 << 12)) if not 0xD800 <= c < 0xE000]
        for make in ("a{0}1", " {0}!", "{0} b"):
            text = "\n".join(make.format(c) for c in chars)
            if text:
                assert bpe.words(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_very_long_word(library, vocabulary):
    same(library, bpe.Coder(vocabulary), ["x" * 5000, "ab" * 3000, "é" * 700, " " * 999])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=50), st.text("the ingando", max_size=45).map(str.encode)), max_size=40))
def test_many_words_merge_as_one(vocabulary, words):
    assert vocabulary.merge_many(words) == [vocabulary.merge(w) for w in words]
    assert [vocabulary._merge_long([vocabulary.single[b] for b in w]) for w in words] == [vocabulary.merge(w) for w in words]


def test_cache_starts_afresh(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 10)
    same(library, bpe.Coder(vocabulary), ["one two three four five six", "seven one two", "eight nine ten eleven"] * 3)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6).filter(lambda b: b"\0" not in b), max_size=60))
def test_lexicon_is_a_minimal_transducer(tmp_path_factory, words):
    entries = [(w, list(w)[:3]) for w in words]
    path = tmp_path_factory.mktemp("lexicon") / "lexicon.bin"
    path.write_bytes(bpe.compile_lexicon(entries))
    lexicon = bpe.Lexicon(str(path))
    found = sorted(words)
    assert lexicon.ranks(found).tolist() == list(range(len(found)))
    for rank, word in enumerate(found):
        assert lexicon.ids[lexicon.offsets[rank]:lexicon.offsets[rank + 1]].tolist() == list(word)[:3]
    others = [w + b"\x01" for w in found if w + b"\x01" not in words] + [b"", b"zzzzzzz"]
    assert (lexicon.ranks([w for w in others if w not in words]) == -1).all()
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)} or {b""}
    endings = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes}
    assert lexicon.states == len(endings)


def test_query_columns(spark, edge):
    got = bpe.code(edge, PATH, ("doc_id", "text"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"), most=50).collect()
    assert len(got) == edge.count()
    library = tokenizers.Tokenizer.from_file(PATH)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_lexicon_does_not_change_ids(spark, edge):
    few, many = (bpe.code(edge, PATH, ("doc_id",), ("ids_sha256",), most=n) for n in (1, 10_000))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_no_rows(nothing):
    assert bpe.code(nothing, PATH, ("doc_id",)).count() == 0
