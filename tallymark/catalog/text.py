"""Queries over words, token sequences, prompts, chats and metrics."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallymark.catalog.sql import BLANKS, COUNTS, WORDS, cleaned, encoded, literal, table, vocabulary as vocabulary_sql
from tallymark.functions import arrays, text
from tallymark.session import materialise
from tallymark.operators import chat, features, metrics, sequences, words
from tallymark.operators.ordering import with_row_index


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _joined(col):
    return F.array_join(F.transform(col, lambda i: i.cast("string")), ",")


def word_extraction(spark, sf_dir):
    """Every counted word with its document and position."""
    return words.words(_docs(spark, sf_dir)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "word")


def word_frequency(spark, sf_dir):
    """Corpus-wide word counts."""
    return words.word_counts(_docs(spark, sf_dir)).select("word", "n")


def top_words(spark, sf_dir):
    """The 10,000 most frequent words, ties first-seen."""
    return words.top_words(words.word_counts(_docs(spark, sf_dir))).withColumn("rank", F.col("rank").cast("bigint"))


def ranked_words(spark, sf_dir):
    """Ranks of up to a million words, more than one task may sort."""
    return words.top_words(words.word_counts(_docs(spark, sf_dir)), 1_000_000)


def word_lengths(spark, sf_dir):
    """Lengths of the distinct words."""
    made = words.word_lengths(words.word_counts(_docs(spark, sf_dir)))
    return made.select(F.col("length").cast("bigint").alias("length"), "n_words")


def token_cleaning(spark, sf_dir):
    """Texts as cleaned tokens."""
    kept = F.filter(text.clean_tokens("text"), lambda t: t != "")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(kept, " ").alias("tokens"))


def vocabulary(spark, sf_dir):
    """The 1,000 most frequent cleaned tokens with their ids."""
    return words.vocabulary(_docs(spark, sf_dir)).withColumn("id", F.col("id").cast("bigint"))


def encoded_texts(spark, sf_dir):
    """Texts as ids of the known words."""
    docs = _docs(spark, sf_dir)
    return sequences.encode(docs, words.vocabulary(docs)).select("doc_id", _joined(F.col("input_ids")).alias("ids"))


def encoded_by_join(spark, sf_dir):
    """The same by a join, for a vocabulary of any size."""
    docs = _docs(spark, sf_dir)
    vocab = words.vocabulary(docs, k=1_000_000)
    return sequences.encode_by_join(docs, vocab, "doc_id").select("doc_id", _joined(F.col("input_ids")).alias("ids"))


def padded_texts(spark, sf_dir):
    """Encoded texts brought to 500 ids."""
    docs = _docs(spark, sf_dir)
    made = sequences.encode(docs, words.vocabulary(docs))
    return made.select("doc_id", _joined(arrays.pad_left("input_ids", 500)).alias("ids"))


def label_encoding(spark, sf_dir):
    """Sentiment labels as 0 and 1."""
    named = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    return named.select("doc_id", features.label_encode("label").cast("bigint").alias("y"))


def tokenized_texts(spark, sf_dir):
    """Ids and attention mask of every text."""
    docs = _docs(spark, sf_dir)
    made = sequences.tokenize(docs, words.vocabulary(docs), keep=("doc_id",))
    return made.select("doc_id", _joined(F.col("input_ids")).alias("ids"), F.size("attention_mask").cast("bigint").alias("mask"))


def _subword_spec():
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    merges = [("t", "h"), ("th", "e"), ("i", "n"), ("e", "r"), ("o", "n")]
    vocab = {t: i for i, t in enumerate(["<unk>", *letters, *["".join(m) for m in merges]])}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [],
                       "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None,
                       "decoder": None, "model": {"type": "BPE", "dropout": None, "unk_token": "<unk>", "fuse_unk": False,
                                                  "continuing_subword_prefix": None, "end_of_word_suffix": None,
                                                  "byte_fallback": False, "ignore_merges": False, "vocab": vocab,
                                                  "merges": [" ".join(m) for m in merges]}})


def subword_tokens(spark, sf_dir):
    """Texts through a given sub-word vocabulary and merge table."""
    made = sequences.tokenize_subwords(_docs(spark, sf_dir), _subword_spec(), keep=("doc_id",))
    return made.select("doc_id", _joined(F.col("input_ids")).alias("ids"))


def _sharded_tokens(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    made = sequences.tokenize(docs, words.vocabulary(docs), keep=("doc_id",))
    return materialise(made.select("doc_id", (F.col("doc_id") % 8).alias("shard"), "input_ids", "attention_mask"))


def packed_chunks(spark, sf_dir):
    """Sequences of a shard in a row, cut into chunks of 1,024; short tails dropped."""
    made = sequences.pack(_sharded_tokens(spark, sf_dir), "input_ids", "shard", "doc_id", aligned=["attention_mask"])
    return made.select("shard", "chunk", _joined(F.col("input_ids")).alias("ids"), _joined(F.col("attention_mask")).alias("mask"))


def concatenated_sequences(spark, sf_dir):
    """The same rows in a row with the tails kept."""
    made = sequences.pack(_sharded_tokens(spark, sf_dir), "input_ids", "shard", "doc_id", drop_tail=False)
    return made.select("shard", "chunk", F.size("input_ids").cast("bigint").alias("n"), _joined(F.col("input_ids")).alias("ids"))


def instruction_prompt(spark, sf_dir):
    """The instruction template filled from texts and labels."""
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    prompt = text.render_prompt(F.concat(F.lit("Rate "), "source"), "text", F.col("quality").cast("string"), "</s>")
    return rows.select("doc_id", prompt.alias("text"))


def few_shot_prompt(spark, sf_dir):
    """Translation prompts for the German texts."""
    german = _docs(spark, sf_dir).where("lang = 'de'")
    return german.select("doc_id", text.render_few_shot("text", "de", "en").alias("prompt"))


def chat_rendering(spark, sf_dir):
    """Conversations in the default chat format."""
    return chat.render_chat(table(spark, sf_dir, "conversations"))


def conversation_samples(spark, sf_dir):
    """``(samples, replies)`` with story, first five questions and their replies."""
    turns = table(spark, sf_dir, "conversations")
    story = chat.first_per_group(turns.where("role = 'system'"), "conv_id", "turn", 1).select("conv_id", F.col("text").alias("story"))
    asked = chat.first_per_group(turns.where("role = 'user'"), "conv_id", "turn", 5, "question_no")
    questions = asked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("question_no", "text"))).alias("q"))
    samples = turns.select("conv_id").distinct().join(questions, "conv_id", "left").join(story, "conv_id", "left").select(
        "conv_id", "story", F.coalesce(F.transform("q", lambda x: x["text"]), F.array().cast("array<string>")).alias("questions"))
    replies = chat.first_per_group(turns.where("role = 'assistant'"), "conv_id", "turn", 5, "question_no").select(
        "conv_id", "question_no", F.col("text").alias("reply"))
    return samples, replies


def conversation_building(spark, sf_dir):
    """Story, questions and replies as conversations."""
    made = chat.build_conversation(*conversation_samples(spark, sf_dir), "conv_id")
    return made.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "content")


def stop_token_cut(spark, sf_dir):
    """Replies cut at the first listed stop string."""
    replies = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    marked = F.when(F.col("turn") % 3 == 0, F.concat(F.col("text"), F.lit("</s> more <|eot_id|> rest"))).when(
        F.col("turn") % 3 == 1, F.concat(F.lit("<|eot_id|>"), "text")).otherwise(F.concat("text", F.lit("<|end|>")))
    return replies.select("conv_id", "turn", text.cut_at_stop(marked).alias("reply"))


def prediction_extraction(spark, sf_dir):
    """The predicted line behind a prompt."""
    docs = _docs(spark, sf_dir)
    full = F.concat(text.render_few_shot("source", "de", "en"), F.lit("  "), "text", F.lit("\nmore"))
    return docs.select("doc_id", text.extract_prediction(full, text.translation_suffix("source", "de", "en")).alias("prediction"))


def _pairs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.col("text").alias("pred"), F.replace("text", F.lit(" the "), F.lit(" a ")).alias("ref"))


def corpus_bleu(spark, sf_dir):
    """Corpus score of texts against altered copies."""
    made = metrics.corpus_bleu(_pairs(spark, sf_dir), "doc_id", "pred", "ref")
    return made.select(F.round("score", 6).alias("score"), F.round("brevity", 9).alias("brevity"), "pred_len", "ref_len")


def ngram_statistics(spark, sf_dir):
    """Clipped n-gram counts of the same pairs, blank-separated tokens."""
    made = metrics.ngram_statistics(_pairs(spark, sf_dir), "doc_id", "pred", "ref", tokenizer="blank")
    return made.withColumn("order", F.col("order").cast("bigint"))


def parallel_pairs(spark, sf_dir):
    """German and English texts paired by their position."""
    docs = with_row_index(_docs(spark, sf_dir), "doc_id", within=["lang"])
    de = docs.where("lang = 'de'").select("row_idx", F.col("text").alias("de"))
    en = docs.where("lang = 'en'").select("row_idx", F.col("text").alias("en"))
    return de.join(en, "row_idx").select("row_idx", "de", "en")


def task_accuracy(spark, sf_dir):
    """Accuracy per task, group and overall from a table of choice scores."""
    items = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    choices = items.select(F.col("lang").alias("grp"), F.concat_ws("-", "lang", "source").alias("task"),
                           F.col("doc_id").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("choice"))
    scores = choices.withColumn("score", (F.col("item") * 7919 + F.col("choice") * 104729) % 10)
    gold = items.select(F.concat_ws("-", "lang", "source").alias("task"), F.col("doc_id").alias("item"), F.col("quality").alias("answer"))
    made = metrics.task_accuracy(scores, gold)
    return made.select("grp", "task", "n", "correct", F.round("accuracy", 9).alias("accuracy"))


def task_tree(spark, sf_dir):
    """Leaf tasks below every task group."""
    docs = _docs(spark, sf_dir).select("lang", "source").distinct()
    leaf = docs.select(F.col("lang").alias("parent"), F.concat_ws("-", "lang", "source").alias("child"))
    top = docs.select(F.lit("all").alias("parent"), F.col("lang").alias("child")).distinct()
    return metrics.flatten_tasks(leaf.unionByName(top))


QUERIES = {f.__name__: f for f in (
    word_extraction, word_frequency, top_words, ranked_words, word_lengths, token_cleaning, vocabulary, encoded_texts, encoded_by_join,
    padded_texts, label_encoding, tokenized_texts, subword_tokens, packed_chunks, concatenated_sequences, instruction_prompt,
    few_shot_prompt, chat_rendering, conversation_building, stop_token_cut, prediction_extraction, corpus_bleu,
    ngram_statistics, parallel_pairs, task_accuracy, task_tree)}

DOCS = "SELECT doc_id, text FROM documents"
VOCAB = vocabulary_sql(DOCS)
ENCODED = encoded(DOCS, VOCAB)


def chunks(enc: str, shard: str, size: int) -> str:
    """``(shard, chunk, ids list)`` of ``(doc_id, ids)`` packed per shard."""
    return f"""
SELECT shard, ofs // {size} AS chunk, list(id ORDER BY ofs) AS ids FROM (
  SELECT shard, id, row_number() OVER (PARTITION BY shard ORDER BY doc_id, p) - 1 AS ofs FROM (
    SELECT doc_id, {shard} AS shard, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM ({enc})))
GROUP BY 1, 2"""


CHUNKS = chunks(ENCODED, "doc_id % 8", 1024)

PIECES = text.INSTRUCTION_TEMPLATE.split("{}")
FEW_SHOT = "Translate the following de sentences into en.\n\n" + "".join(f"de: {a}\nen: {b}\n\n" for a, b in text.TRANSLATION_EXAMPLES)

TURN = """CASE role WHEN 'system' THEN '<start_of_turn>user' WHEN 'user' THEN '<start_of_turn>user'
WHEN 'assistant' THEN '<start_of_turn>model' END || chr(10) || text || '<end_of_turn>' || chr(10)"""


def cut_sql(col: str) -> str:
    cases = " ".join(f"WHEN instr({col}, {literal(s)}) > 0 THEN left({col}, instr({col}, {literal(s)}) - 1)" for s in text.STOP_STRINGS)
    return f"CASE {cases} ELSE {col} END"


CONVERSATION = f"""
WITH q AS MATERIALIZED (SELECT conv_id, text, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS no
  FROM conversations WHERE role = 'user'),
r AS MATERIALIZED (SELECT conv_id, text, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS no
  FROM conversations WHERE role = 'assistant'),
s AS MATERIALIZED (SELECT conv_id, arg_min(text, turn) AS story FROM conversations WHERE role = 'system' GROUP BY 1)
SELECT DISTINCT conv_id, 0::BIGINT AS turn, 'system' AS role, {literal(text.CONTEXT_MESSAGE)} || coalesce(story, '') AS content
FROM conversations LEFT JOIN s USING (conv_id)
UNION ALL SELECT conv_id, 2 * no + 1, 'user', text FROM q WHERE no < 5
UNION ALL SELECT q.conv_id, 2 * q.no + 2, 'assistant', coalesce(r.text, '') FROM q LEFT JOIN r USING (conv_id, no) WHERE q.no < 5
"""


def bleu_tokens_sql(col: str) -> str:
    out = f"coalesce({col}, '')"
    for found, put in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"),
                       ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        out = f"replace({out}, {found}, {put})"
    out = f"(' ' || {out} || ' ')"
    for found, put in ((r"([\x{7b}-\x{7e}\x{5b}-\x{60}\x{20}-\x{26}\x{28}-\x{2b}\x{3a}-\x{40}\x{2f}])", r" \1 "),
                       (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        out = f"regexp_replace({out}, '{found}', '{put}', 'g')"
    return f"list_filter(regexp_split_to_array({out}, '{BLANKS}'), lambda t: t <> '')"


ALTERED = "SELECT doc_id, text AS pred, replace(text, ' the ', ' a ') AS ref FROM documents"


def ngrams_sql(tokens, max_n: int = 4, pairs: str = ALTERED) -> str:
    sides = [f"SELECT doc_id, {p} AS p, {1 - p} AS r, {tokens(col)} AS t FROM pairs" for p, col in ((1, "pred"), (0, "ref"))]
    lead = {1: "w"} | {n: f"{' || '.join(['w'] + [f'chr(32) || lead(w, {k}) OVER s' for k in range(1, n)])}" for n in range(2, max_n + 1)}
    columns = ", ".join(f"{expr} AS g{n}" for n, expr in lead.items())
    grams = " UNION ALL ".join(f"SELECT doc_id, p, r, {n} AS ord, g{n} AS gram FROM runs WHERE g{n} IS NOT NULL" for n in lead)
    return f"""
WITH pairs AS ({pairs}),
sides AS ({' UNION ALL '.join(sides)}),
tokens AS (SELECT doc_id, p, r, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM sides),
runs AS (SELECT doc_id, p, r, {columns} FROM tokens WINDOW s AS (PARTITION BY doc_id, p ORDER BY i)), grams AS ({grams}),
counted AS (SELECT doc_id, ord, gram, sum(p) AS p, sum(r) AS r FROM grams GROUP BY ALL)
SELECT ord::BIGINT AS "order", sum(least(p, r))::BIGINT AS matches, sum(p)::BIGINT AS total, sum(r)::BIGINT AS ref_total
FROM counted GROUP BY ord"""


def bleu_sql(pairs: str) -> str:
    """Score, brevity and lengths of ``(doc_id, pred, ref)`` whose n-grams all match somewhere."""
    return f"""
WITH g AS ({ngrams_sql(bleu_tokens_sql, pairs=pairs)}),
s AS (SELECT sum(total) FILTER ("order" = 1) AS c, sum(ref_total) FILTER ("order" = 1) AS r, exp(avg(ln(100.0::DOUBLE * matches / total))) AS m FROM g),
b AS (SELECT *, CASE WHEN c < r THEN exp(1 - r::DOUBLE / c) ELSE 1.0::DOUBLE END AS bp FROM s)
SELECT round(bp * m, 6) AS score, round(bp, 9) AS brevity, c::BIGINT AS pred_len, r::BIGINT AS ref_len FROM b"""


ORACLES = {
    "word_extraction": f"SELECT doc_id, pos, word FROM ({WORDS})",
    "word_frequency": f"SELECT word, n FROM ({COUNTS})",
    "ranked_words": f"SELECT row_number() OVER (ORDER BY n DESC, first_seen) AS rank, word, n FROM ({COUNTS}) ORDER BY rank LIMIT 1000000",
    "top_words": f"SELECT row_number() OVER (ORDER BY n DESC, first_seen) AS rank, word, n FROM ({COUNTS}) ORDER BY rank LIMIT 10000",
    "word_lengths": f"SELECT length(word) AS length, count(*) AS n_words FROM ({COUNTS}) GROUP BY 1",
    "token_cleaning": f"""
SELECT d.doc_id, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS tokens FROM documents d
LEFT JOIN (SELECT * FROM ({cleaned(DOCS)}) WHERE word <> '') t USING (doc_id) GROUP BY d.doc_id""",
    "vocabulary": VOCAB,
    "encoded_texts": f"SELECT doc_id, array_to_string(ids, ',') AS ids FROM ({ENCODED})",
    "encoded_by_join": f"SELECT doc_id, array_to_string(ids, ',') AS ids FROM ({encoded(DOCS, vocabulary_sql(DOCS, 1_000_000))})",
    "padded_texts": f"""
SELECT doc_id, array_to_string(list_concat(list_transform(range(500 - len(ids[:500])), lambda i: 0), ids[:500]), ',') AS ids FROM ({ENCODED})""",
    "label_encoding": "SELECT doc_id, (quality = 1)::BIGINT AS y FROM labels",
    "tokenized_texts": f"SELECT doc_id, array_to_string(ids, ',') AS ids, len(ids) AS mask FROM ({ENCODED})",
    "packed_chunks": f"SELECT shard, chunk, array_to_string(ids, ',') AS ids, array_to_string(list_transform(ids, lambda i: 1), ',') AS mask FROM ({CHUNKS}) WHERE len(ids) = 1024",
    "concatenated_sequences": f"SELECT shard, chunk, len(ids) AS n, array_to_string(ids, ',') AS ids FROM ({CHUNKS})",
    "instruction_prompt": f"""
SELECT doc_id, {literal(PIECES[0])} || 'Rate ' || source || {literal(PIECES[1])} || text || {literal(PIECES[2])} || quality
       || {literal(PIECES[3] + '</s>')} AS text FROM documents JOIN labels USING (doc_id)""",
    "few_shot_prompt": f"""
SELECT doc_id, {literal(FEW_SHOT)} || 'de: ' || text || chr(10) || 'en:' AS prompt FROM documents WHERE lang = 'de'""",
    "chat_rendering": f"""
SELECT conv_id, coalesce(string_agg({TURN}, '' ORDER BY turn), '') || '<start_of_turn>model' || chr(10) AS prompt
FROM conversations GROUP BY conv_id""",
    "conversation_building": CONVERSATION,
    "stop_token_cut": f"""
SELECT conv_id, turn, {cut_sql('reply')} AS reply FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || '</s> more <|eot_id|> rest'
  WHEN 1 THEN '<|eot_id|>' || text ELSE text || '<|end|>' END AS reply FROM conversations WHERE role = 'assistant')""",
    "prediction_extraction": f"""
SELECT doc_id, regexp_replace(split_part(regexp_replace('  ' || text || chr(10) || 'more', '^{BLANKS}', ''), chr(10), 1), '{BLANKS}$', '')
       AS prediction FROM documents""",
    "corpus_bleu": bleu_sql(ALTERED),
    "ngram_statistics": ngrams_sql(lambda c: f"list_filter(regexp_split_to_array({c}, '{BLANKS}'), lambda t: t <> '')"),
    "parallel_pairs": """
WITH d AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_idx FROM documents)
SELECT a.row_idx, a.text AS de, b.text AS en FROM d a JOIN d b USING (row_idx) WHERE a.lang = 'de' AND b.lang = 'en'""",
    "task_accuracy": """
WITH c AS (SELECT lang AS grp, lang || '-' || source AS task, doc_id, quality, unnest(range(4)) AS choice FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT grp, task, doc_id, any_value(quality) AS answer,
      list(choice ORDER BY (doc_id * 7919 + choice * 104729) % 10 DESC, choice)[1] AS choice FROM c GROUP BY ALL)
SELECT grp, task, count(*) AS n, sum(coalesce(choice = answer, false)::BIGINT)::BIGINT AS correct,
       round(avg(coalesce(choice = answer, false)::INTEGER), 9) AS accuracy
FROM m GROUP BY ROLLUP (grp, task)""",
    "task_tree": """
SELECT DISTINCT 'all' AS grp, lang || '-' || source AS task FROM documents""",
}
