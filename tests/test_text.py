"""Words, vocabularies, sequences, prompts, chats and metrics against plain Python."""

import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.functions import arrays, text
from tallymark.operators import chat, metrics, sequences, words

WORD = re.compile(r"\b[a-zA-Z]+\b")


def plain_words(t):
    return [w for w in WORD.findall((t or "").lower()) if w not in text.STOP_WORDS and len(w) > 1]


def plain_clean(token):
    return re.sub(r"\d", "", re.sub(r"\s+", "", re.sub(r"[^\w\s]", "", token)))


def rows_of(docs):
    return sorted(docs.collect(), key=lambda r: r.doc_id)


def test_word_list():
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 179


def test_words_counts_and_ties(spark, docs):
    got = words.words(docs).orderBy("doc_id", "pos").select("word")
    assert [r.word for r in got.collect()] == [w for r in rows_of(docs) for w in plain_words(r.text)]
    counter = Counter(w for r in rows_of(docs) for w in plain_words(r.text))
    counts = words.word_counts(docs)
    assert {r.word: r.n for r in counts.collect()} == dict(counter)
    by_text = words.word_counts(docs.withColumn("doc_id", F.format_string("%09d", F.col("doc_id"))))  # ids that are no numbers
    for made in (counts, by_text):
        for k in (3, 100):
            assert [(r.word, r.n) for r in words.top_words(made, k).orderBy("rank").collect()] == counter.most_common(k)
    lengths = {r.length: r.n_words for r in words.word_lengths(counts).collect()}
    assert lengths == dict(Counter(len(w) for w in counter))


def test_first_seen_has_one_type_for_all_ids(spark):
    ids = [-(2**63), -5, 0, 1, 1 << 40, 2**63 - 1]
    kinds = set()
    for some in (ids, ids[2:4], []):
        df = spark.createDataFrame([(i, f"word{'abcdef'[n]} word{'abcdef'[n]} shared") for n, i in enumerate(some)], "doc_id bigint, text string")
        counts = words.word_counts(df.repartition(3))
        kinds.add(counts.schema.simpleString())
        want = [("shared", len(some))] * bool(some) + [(f"word{'abcdef'[n]}", 2) for n in range(len(some))]
        order = {"shared": (min(some, default=0), 2)} | {f"word{'abcdef'[n]}": (i, 0) for n, i in enumerate(some)}
        want.sort(key=lambda w: (-w[1], order[w[0]]))
        assert [(r.word, r.n) for r in words.top_words(counts, 100).orderBy("rank").collect()] == want
    assert len(kinds) == 1


def test_top_of_any_size_without_one_task_for_all(spark, docs, monkeypatch):
    rng = __import__("random").Random(2)
    pool = [f"w{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    df = spark.createDataFrame([(rng.choice([-1, 1]) * i * 10**9, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(300)],
                               "doc_id bigint, text string").repartition(4)
    counts = words.word_counts(df)
    for k in (1, 7, 100, 10_000):
        monkeypatch.setattr(words, "DIRECT", 10**9)
        want = [tuple(r) for r in words.top_words(counts, k).orderBy("rank").collect()]
        monkeypatch.setattr(words, "DIRECT", 0)
        made = words.top_words(counts, k)
        assert [tuple(r) for r in made.orderBy("rank").collect()] == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("SinglePartition, ENSURE_REQUIREMENTS, [plan_id", "") or "TakeOrdered" not in plan
    assert words.top_words(counts.where("false"), 10).count() == 0


def test_stop_words_do_not_reach_the_shuffle_and_count_is_hashed(spark, docs):
    plan = words.word_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Python" not in plan


def plain_vocabulary(texts, k):
    counter = Counter()
    for t in texts:
        counter.update(w for w in (plain_clean(x) for x in (t or "").lower().split()) if w and w not in text.STOP_WORDS)
    return {w: i for i, (w, _) in enumerate(sorted(counter.items(), key=lambda x: -x[1])[:k], 1)}


def test_vocabulary_encode_pad(spark, docs):
    texts = [r.text for r in rows_of(docs)]
    vocab = words.vocabulary(docs, k=6)
    plain = plain_vocabulary(texts, 6)
    assert {r.word: r.id for r in vocab.collect()} == plain
    want = [[plain[w] for w in (plain_clean(x) for x in (t or "").lower().split()) if w in plain] for t in texts]
    for made in (sequences.encode(docs, vocab), sequences.encode_by_join(docs, vocab, "doc_id")):
        assert [list(r.input_ids) for r in rows_of(made)] == want
    padded = rows_of(sequences.encode(docs, vocab).withColumn("p", arrays.pad_left("input_ids", 3)))
    assert [list(r.p) for r in padded] == [[0] * (3 - len(w[:3])) + w[:3] for w in want]
    plan = sequences.encode(docs, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_large_vocabulary_is_joined(spark, docs, monkeypatch):
    monkeypatch.setattr(sequences, "LOOKUP_WORDS", 2)
    vocab = words.vocabulary(docs, k=6)
    want = [r.input_ids for r in rows_of(sequences.encode_by_join(docs, vocab, "doc_id"))]
    for made in (sequences.encode(docs, vocab, key="doc_id"), sequences.encode(docs, vocab)):
        assert [r.input_ids for r in rows_of(made)] == want


@pytest.mark.parametrize("token", ["it's", "a1b2", "x_y", "naïve", "²³", "...", "no break"])
def test_clean_token(spark, token):
    got = spark.createDataFrame([(token,)], "t string").select(text.clean_token("t").alias("t")).first().t
    assert got == plain_clean(token)


def test_unicode_blanks(spark):
    sample = "a b c\x1cd\x85e　f\tg\r\nh i"
    df = spark.createDataFrame([(sample,)], "t string")
    assert list(df.select(metrics.blank_tokens("t").alias("t")).first().t) == sample.split()
    assert df.select(text.strip_blanks(F.concat(F.lit(" \n "), "t", F.lit("  "))).alias("t")).first().t == sample


def pack_plain(rows, size, drop):
    out = {}
    for shard in {s for s, _, _ in rows}:
        line = [t for s, _, toks in sorted(rows, key=lambda r: r[1]) if s == shard for t in toks]
        for i in range(0, len(line), size):
            if not drop or len(line[i:i + size]) == size:
                out[(shard, i // size)] = line[i:i + size]
    return out


@pytest.mark.parametrize("drop", [True, False])
def test_pack(spark, drop):
    rows = [(0, 1, list(range(1000))), (0, 5, list(range(24))), (1, 2, list(range(1023))), (2, 3, list(range(2049))),
            (3, 7, []), (4, 8, [1] * 500), (4, 9, []), (4, 4000, [2] * 5000), (4, 70000, [3] * 41)]
    df = spark.createDataFrame(rows, "shard int, k bigint, t array<int>").repartition(4)
    got = {(r.shard, r.chunk): list(r.t) for r in sequences.pack(df, "t", "shard", "k", drop_tail=drop).collect()}
    assert got == pack_plain(rows, 1024, drop)


def test_subwords(spark, docs):
    from tallymark.catalog.text import _subword_spec

    df = spark.createDataFrame([(1, "the tin"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: (list(r.input_ids), list(r.attention_mask)) for r in
           sequences.tokenize_subwords(df, _subword_spec(), keep=("doc_id",)).collect()}
    assert got[2] == ([], []) and len(got[1][0]) == 3 and got[1][1] == [1, 1, 1]


def test_subwords_are_encoded_in_slices():
    from tallymark.catalog.text import _subword_spec
    from tallymark.functions.batches import SLICE_CHARS

    texts = pd.Series(["the tin " * 250] * 300 + [None, "in " * SLICE_CHARS, "on"])
    made = list(sequences.subword_ids(_subword_spec(), iter([texts, texts[:0]])))
    assert [len(ids) for part in made for ids in part] == [750] * 300 + [0, SLICE_CHARS, 1]
    assert max(map(len, made)) <= SLICE_CHARS // 2000 + 3 and len(made[-1]) == 1


def test_prompts(spark):
    df = spark.createDataFrame([("do", "this", None), ("a", "{}", "b")], "i string, g string, o string")
    got = [r.t for r in df.select(text.render_prompt("i", "g", "o", "<e>").alias("t")).collect()]
    assert got == [text.INSTRUCTION_TEMPLATE.replace("{}", "\0").replace("\0", i, 1).replace("\0", g, 1).replace("\0", o or "", 1) + "<e>"
                   for i, g, o in [("do", "this", None), ("a", "{}", "b")]]
    assert got[0].endswith("\n\n    ### Response:\n    <e>")
    shot = spark.createDataFrame([("Hallo",)], "s string").select(text.render_few_shot("s", "de", "en").alias("t")).first().t
    assert shot == ("Translate the following de sentences into en.\n\nde: Ich liebe Programmierung.\nen: I love programming.\n\n"
                    "de: Guten Morgen!\nen: Good morning!\n\nde: Hallo\nen:")


def cut_plain(reply):
    for stop in text.STOP_STRINGS:
        if stop in reply:
            return reply[:reply.find(stop)]
    return reply


@pytest.mark.parametrize("reply", ["none", "a</s>b<|eot_id|>c", "<|end|>", "x<end_of_turn>y<|im_end|>", "é</s>", ""])
def test_cut_at_stop(spark, reply):
    assert spark.createDataFrame([(reply,)], "r string").select(text.cut_at_stop("r").alias("r")).first().r == cut_plain(reply)


@pytest.mark.parametrize("full", ["p de: x\nen: good \nrest", "no suffix\nhere", "de: x\nen: a\nde: x\nen:  b \n", "de: x\nen:", "de: x\nen:\n\n c d\ne"])
def test_extract_prediction(spark, full):
    suffix = "de: x\nen:"
    df = spark.createDataFrame([(full, suffix)], "f string, s string")
    want = full.split(suffix)[-1].strip().split("\n")[0].strip()
    assert df.select(text.extract_prediction("f", "s").alias("p")).first().p == want


def chat_plain(turns):
    shown = {"system": "user", "user": "user", "assistant": "model"}
    return "".join(f"<start_of_turn>{shown[r]}\n{c}<end_of_turn>\n" for r, c in turns if r in shown) + "<start_of_turn>model\n"


def test_chat(spark):
    talks = {1: [("system", "s"), ("user", "q"), ("assistant", "a")], 2: [("tool", "x")], 3: [("user", str(i)) for i in range(700)]}
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    assert {r.conv_id: r.prompt for r in chat.render_chat(df).collect()} == {c: chat_plain(t) for c, t in talks.items()}
    assert chat.render_chat_parts(df).where("conv_id = 3").count() == 3


def test_conversation(spark):
    samples = spark.createDataFrame([(1, "once", [f"q{i}" for i in range(7)]), (2, None, ["only"])], "k bigint, story string, questions array<string>")
    replies = spark.createDataFrame([(1, i, f"a{i}") for i in range(5)], "k bigint, question_no int, reply string")
    rows = sorted(chat.build_conversation(samples, replies, "k").collect(), key=lambda r: (r.k, r.turn))
    first = [(r.role, r.content) for r in rows if r.k == 1]
    assert first[0] == ("system", text.CONTEXT_MESSAGE + "once")
    assert first[1:] == [x for i in range(5) for x in (("user", f"q{i}"), ("assistant", f"a{i}"))]
    assert [r.content for r in rows if r.k == 2] == [text.CONTEXT_MESSAGE, "only", ""]


def test_rare_words_are_joined_by_shuffle(spark, docs, monkeypatch):
    vocab = words.vocabulary(docs, k=6)
    want = [r.input_ids for r in rows_of(sequences.encode(docs, vocab))]
    monkeypatch.setattr(sequences, "BROADCAST_ROWS", 2)
    assert [r.input_ids for r in rows_of(sequences.encode_by_join(docs, vocab, "doc_id"))] == want


def test_tokens_are_those_of_a_split_by_blanks(spark):
    rng, parts = __import__("random").Random(3), [" ", "  ", "\t", "\r\n", "\x1c", "\x85", "\u00a0", "\u2003 ", "\u3000", "\u200b", "\x00", "a", "é", "don't", "漢", "𝒳", "²", "7", "_"]
    rows = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))),) for _ in range(2000)], "t string")
    plain = F.split(F.regexp_replace(F.lower("t"), text.NOISE, ""), text.BLANKS)
    assert rows.where(~text.clean_tokens("t").eqNullSafe(plain)).count() == 0


@pytest.mark.parametrize("frequent", [0, 3, 100])
def test_frequent_words_are_no_rows(spark, monkeypatch, frequent):
    rng = __import__("random").Random(5)
    pool = [f"w{a}{b}" for a in "abcdef" for b in "abcdef"] + ["the", "...", "naïve"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 50, 400]))) for _ in range(60)] + ["", None, " the ", "waa " * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    vocab = words.vocabulary(docs, k=20).unionByName(spark.createDataFrame([("the", 21)], "word string, id int"))
    plain = {r.word: r.id for r in vocab.collect()}
    monkeypatch.setattr(sequences, "BROADCAST_ROWS", frequent)
    made = sequences.encode_by_join(docs, vocab, "doc_id").withColumnRenamed("input_ids", "ids")
    want = [[plain[w] for w in (plain_clean(x) for x in (t or "").lower().split()) if w in plain] for t in texts]
    assert [list(r.ids) for r in sorted(made.collect(), key=lambda r: r.doc_id)] == want
    assert made.columns == ["doc_id", "text", "ids"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and (frequent < 100 or "Join" not in plan)


def test_ids_are_filled_in_by_slices(monkeypatch):
    ids = pa.array([[9], [1, None, None, 4], None, [], [None, None], [5, 6]], pa.list_(pa.int32()))[1:]
    places, rare = pa.array([[2], None, None, [1, 0], []], pa.list_(pa.int32())), pa.array([[30], None, None, [21, 20], []], pa.list_(pa.int32()))
    for size in (1, 3, 100):
        monkeypatch.setattr(sequences.list_slices, "__defaults__", (size,))
        got = [x for part in sequences.filled_ids(iter([(ids, places, rare)])) for x in part.to_pylist()]
        assert got == [[1, 30, 4], [], [], [20, 21], [5, 6]]


def test_first_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    plan = chat.first_per_group(df, "g", "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def bleu_plain(pairs, max_n=4):
    hits, totals, c, r = [0] * max_n, [0] * max_n, 0, 0
    for pred, ref in pairs:
        p, q = pred.split(), ref.split()
        c, r = c + len(p), r + len(q)
        for n in range(1, max_n + 1):
            a = Counter(tuple(p[i:i + n]) for i in range(len(p) - n + 1))
            b = Counter(tuple(q[i:i + n]) for i in range(len(q) - n + 1))
            hits[n - 1] += sum((a & b).values())
            totals[n - 1] += sum(a.values())
    if not any(hits) or 0 in totals:
        return 0.0
    smooth, logs = 1.0, 0.0
    for h, t in zip(hits, totals):
        if h == 0:
            smooth *= 2
        logs += math.log(100.0 * h / t if h else 100.0 / (smooth * t))
    return (1.0 if c > r else math.exp(1 - r / c)) * math.exp(logs / max_n)


@pytest.mark.parametrize("pairs", [
    [("the cat sat on the mat", "the cat sat on the mat"), ("a b c d e", "a b x d e f g")],
    [("the the the the", "the cat"), ("one two three four five", "five four three two one")],
    [("short", "short")], [("", "x y")], [("a b c d", "w x y z")]])
def test_bleu(spark, pairs):
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "k bigint, p string, r string")
    assert metrics.corpus_bleu(df, "k", "p", "r", tokenizer="blank").first().score == pytest.approx(bleu_plain(pairs), abs=1e-9)


def test_pairs_are_counted_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SLICE_BYTES", 9)
    pairs = [("a b a b c", "a b d a b"), (None, "a b"), ("", ""), ("a b", None), ("a b " * 50, "b a " * 40), ("c", "c")]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "k bigint, p string, r string").coalesce(2)
    made = metrics.ngram_statistics(df, "k", "p", "r", 5, "blank")
    grams = [Counter(), Counter()]
    for k, pair in enumerate(pairs):
        for side, words_of in zip(grams, ((t or "").split() for t in pair)):
            side.update((n, k, *words_of[i:i + n]) for n in range(1, 6) for i in range(len(words_of) - n + 1))
    want = {n: tuple(sum(c for g, c in counts.items() if g[0] == n) for counts in (grams[0] & grams[1], *grams)) for n in range(1, 6)}
    assert {r.order: (r.matches, r.total, r.ref_total) for r in made.collect()} == want
    assert metrics.ngram_statistics(df.where("k > 4"), "k", "p", "r", 5, "blank").count() == 1
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pair" not in plan and "hashpartitioning(k" not in plan and "Window" not in plan
    nothing = pa.array([], pa.list_(pa.string()))
    assert metrics.clipped_counts(nothing, nothing, 2).tolist() == [[0, 0, 0]] * 2


def test_evaluation_tokens(spark):
    sample = "Hello, world! It's 3,000.5 end. A-b 5-6 &quot;q&quot; x/y"
    got = spark.createDataFrame([(sample,)], "t string").select(metrics.evaluation_tokens("t").alias("t")).first().t
    assert list(got) == ["Hello", ",", "world", "!", "It's", "3,000.5", "end", ".", "A-b", "5", "-", "6", '"', "q", '"', "x", "/", "y"]


def test_task_accuracy(spark):
    scores = spark.createDataFrame([("g", "a", 1, 0, 5.0), ("g", "a", 1, 1, 5.0), ("g", "a", 2, 0, 1.0), ("g", "a", 2, 1, 2.0), ("g", "b", 1, 1, 0.5)],
                                   "grp string, task string, item bigint, choice int, score double")
    gold = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 1, 1)], "task string, item bigint, answer int")
    got = {(r.grp, r.task): (r.n, r.correct) for r in metrics.task_accuracy(scores, gold).collect()}
    assert got == {("g", "a"): (2, 1), ("g", "b"): (1, 1), ("g", None): (3, 2), (None, None): (3, 2)}


def test_vocabulary_difference(spark):
    a = spark.createDataFrame([("vocabulary", "x", "1"), ("vocabulary", "y", "2"), ("special", "pad", None)], "section string, token string, value string")
    b = spark.createDataFrame([("vocabulary", "x", "1"), ("vocabulary", "z", "2"), ("special", "pad", None)], "section string, token string, value string")
    got = {r.section: (r.missing, r.extra, r.changed, r.same) for r in words.vocabulary_difference(a, b).collect()}
    assert got == {"vocabulary": (1, 1, 0, 1), "special": (0, 0, 0, 1)}
    assert tuple(words.tokenizers_equal(words.vocabulary_difference(a, b)).first()) == (False, "vocabulary")
    assert tuple(words.tokenizers_equal(words.vocabulary_difference(a, a)).first()) == (True, None)
