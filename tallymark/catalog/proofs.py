"""Queries that run a whole proof."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog.evidence import evidence_sql
from tallymark.catalog.sql import COUNTS, table, vocabulary
from tallymark.catalog.evidence import DOC
from tallymark.catalog.text import (CONVERSATION, DOCS, PIECES, bleu_sql, bleu_tokens_sql, chunks, conversation_samples, cut_sql, literal,
                                    ngrams_sql)
from tallymark.operators import evidence as ev
from tallymark.operators import words
from tallymark.plans import proofs
from tallymark.session import fresh_path, materialise
from tallymark.sources import files, shards


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _settings(spark, sf_dir):
    """A settings table derived from the nations."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))


def _model(spark, sf_dir, name):
    """An artifact's files, made of the parts of one size."""
    size = {"base": 1, "original": 2, "finetuned": 3, "model": 4}[name]
    return table(spark, sf_dir, "part").where(F.col("p_size") == size).select(
        F.concat(F.lit(f"{name}-"), F.col("p_partkey").cast("string")).alias("file"), F.sha2("p_name", 256).alias("sha256"))


def _ordered(evidence):
    return evidence.select(*ev.COLUMNS)


def proof_distribution(spark, sf_dir):
    """Word statistics with measured rows."""
    return _ordered(proofs.distribution(_docs(spark, sf_dir), algo="sum")[0])


def proof_distribution_group(spark, sf_dir):
    """The same with the group element as row digest."""
    return _ordered(proofs.distribution(_docs(spark, sf_dir), proof="distribution_wiki")[0])


def proof_distribution_curve(spark, sf_dir):
    """The same with the curve point as row digest."""
    return _ordered(proofs.distribution(_docs(spark, sf_dir), algo="curve", proof="distribution_curve")[0])


def _vocab(docs):
    return materialise(words.vocabulary(docs))


def proof_preprocess(spark, sf_dir):
    """Tokenized and stored dataset with its shard digests."""
    docs = _docs(spark, sf_dir)
    return _ordered(proofs.preprocess(docs, _vocab(docs), fresh_path(spark, "tokens"), max_shard_mb=1)[0])


def proof_preprocess_head(spark, sf_dir):
    """The same over the first hundredth of the rows."""
    docs = _docs(spark, sf_dir)
    return _ordered(proofs.preprocess(docs, _vocab(docs), fresh_path(spark, "tokens"), divisor=100, proof="preprocess_wiki")[0])


def proof_bind(spark, sf_dir):
    """Stored files and rows read from them."""
    docs = _docs(spark, sf_dir).withColumn("split", F.lit("train"))
    path = fresh_path(spark, "bound")
    shards.write_dataset(docs, path, "doc_id", 1, "split")
    read = shards.read_dataset(spark, path)
    return _ordered(proofs.binding(shards.file_manifest(spark, path), docs, read, DOC[1:], "doc_id")[0])


def proof_pretrain_data(spark, sf_dir):
    """Chunks per split."""
    docs = _docs(spark, sf_dir)
    made = proofs.pretrain_data(docs, _vocab(docs), _settings(spark, sf_dir), test=0.1, artifacts=_model(spark, sf_dir, "model"), algo="sum")[0]
    return _ordered(made)


def proof_finetune_data(spark, sf_dir):
    """Instruction texts."""
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.concat(F.lit("Rate "), "source").alias("instruction"), F.col("text").alias("input"),
        F.col("quality").cast("string").alias("output"))
    models = {name: (_model(spark, sf_dir, name), _settings(spark, sf_dir)) for name in ("base", "original", "finetuned")}
    vocab = _vocab(_docs(spark, sf_dir))
    return _ordered(proofs.finetune_data(rows, _settings(spark, sf_dir), "doc_id", "</s>", models, vocab, algo="sum")[0])


def proof_inference_data(spark, sf_dir):
    """Conversations of questions and replies."""
    samples, replies = conversation_samples(spark, sf_dir)
    replies = replies.withColumn("reply", F.concat("reply", F.lit("<|im_end|>")))
    made = proofs.inference_data(samples, replies, "conv_id", _settings(spark, sf_dir), _model(spark, sf_dir, "model"), algo="sum")[0]
    return _ordered(made)


def proof_evaluation(spark, sf_dir):
    """Task splits and accuracy."""
    items = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("lang").alias("grp"), F.col("source").alias("task"), F.col("lang").alias("split"),
        F.concat_ws("-", "lang", "source").alias("leaf"), "doc_id", "text", "quality")
    scores = items.select("grp", F.col("leaf").alias("task"), F.col("doc_id").alias("item"),
                          F.explode(F.sequence(F.lit(0), F.lit(3))).alias("choice"))
    scores = scores.withColumn("score", (F.col("item") * 7919 + F.col("choice") * 104729) % 10)
    gold = items.select(F.col("leaf").alias("task"), F.col("doc_id").alias("item"), F.col("quality").alias("answer"))
    made = proofs.evaluation(items, scores, gold, ["text", "quality"], "doc_id", _settings(spark, sf_dir), _model(spark, sf_dir, "model"),
                             _vocab(_docs(spark, sf_dir)), algo="sum")[0]
    return _ordered(made)


def proof_evaluation_bleu(spark, sf_dir):
    """Predictions cut from generated texts, and their score."""
    docs = _docs(spark, sf_dir)
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    pairs = docs.select("doc_id", F.col("source").alias("de"), line.alias("en"))
    generated = F.concat(F.lit("de: "), "de", F.lit("\nen: "), F.replace("en", F.lit(" the "), F.lit(" a ")), F.lit("\nrest"))
    made = proofs.evaluation_bleu(pairs.withColumn("generated", generated), "doc_id", "de", "en", "generated", "de", "en", _settings(spark, sf_dir),
                                  _model(spark, sf_dir, "model"), _vocab(docs), algo="sum")[0]
    return _ordered(made)


def proof_quantize(spark, sf_dir):
    """Two artifact folders and a configuration."""
    path = fresh_path(spark, "artifact")
    table(spark, sf_dir, "part").write.parquet(path)
    original = ev.artifact_manifest(files.file_digests(spark, sf_dir), sf_dir)
    quantized = ev.artifact_manifest(files.file_digests(spark, path, pattern="*.parquet"), path)
    return _ordered(proofs.quantization(original, quantized, _settings(spark, sf_dir))[0])


QUERIES = {f.__name__: f for f in (
    proof_distribution, proof_distribution_group, proof_distribution_curve, proof_preprocess, proof_preprocess_head, proof_bind, proof_pretrain_data,
    proof_finetune_data, proof_inference_data, proof_evaluation, proof_evaluation_bleu, proof_quantize)}


def _row(proof, section, name, algo, n, digest, source):
    return (f"SELECT {literal(proof)} AS proof, {literal(section)} AS section, {literal(name)} AS name, {literal(algo)} AS algo, "
            f"{n}::BIGINT AS n_rows, to_base64(unhex({digest})) AS digest_b64 FROM ({source})")


def _chain(rows):
    """Chain digest of at most one block: ``(n, chain)``."""
    return (f"SELECT count(*) AS n, list_reduce(list_prepend('none', list(h ORDER BY i)), lambda acc, x: sha256(x || acc)) AS chain "
            f"FROM ({rows})")


SETTINGS = ("SELECT sha256('{' || string_agg('\"' || n_name || '\":\"' || n_regionkey || '\"', ',' ORDER BY n_name) || '}') AS h FROM nation")


def _settings_row(proof, name):
    return _row(proof, "configuration", name, "sha256", "NULL", "h", SETTINGS)


def _model_rows(proof, section, name):
    size = {"base": 1, "original": 2, "finetuned": 3, "model": 4}[name]
    return (f"SELECT {literal(proof)} AS proof, {literal(section)} AS section, {literal(name + '-')} || p_partkey AS name, 'sha256' AS algo, "
            f"NULL::BIGINT AS n_rows, to_base64(unhex(sha256(p_name))) AS digest_b64 FROM part WHERE p_size = {size}")


def _vocab_row(proof):
    rows = "SELECT id - 1 AS i, sha256(to_json({'word': word, 'id': id})::VARCHAR) AS h FROM (" + vocabulary(DOCS) + ")"
    return _row(proof, "tokenizer_hash", "vocabulary", "chain", "n", "chain", _chain(rows))


DOC_ELEMENTS = "SELECT to_json({'text': text})::VARCHAR || '#' || doc_id AS elem FROM documents"
LENGTHS = (f"SELECT length - 1 AS i, sha256(to_json({{'length': length, 'n_words': n_words}})::VARCHAR) AS h FROM "
           f"(SELECT length(word) AS length, count(*) AS n_words FROM ({COUNTS}) GROUP BY 1)")
TOP = f"""
SELECT count(*) AS n, sha256('Rank,Word,Frequency' || chr(13) || chr(10)
       || string_agg(rank || ',' || word || ',' || n, chr(13) || chr(10) ORDER BY rank) || chr(13) || chr(10)) AS h
FROM (SELECT *, row_number() OVER (ORDER BY n DESC, first_seen) AS rank FROM ({COUNTS}) ORDER BY rank LIMIT 10000)"""

PROMPT = (f"{literal(PIECES[0])} || instruction || {literal(PIECES[1])} || input || {literal(PIECES[2])} || output || "
          f"{literal(PIECES[3] + '</s>')}")
INSTRUCTIONS = "SELECT doc_id, 'Rate ' || source AS instruction, text AS input, quality::VARCHAR AS output FROM documents JOIN labels USING (doc_id)"

SPLIT_ROWS = """
SELECT doc_id, row_idx, text, CASE WHEN row_number() OVER (ORDER BY sha256('0:' || doc_id)) <= ceil(0.1::DOUBLE * count(*) OVER ())
       THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents) WHERE row_idx < 25000"""

PACKED = f"""
WITH parts AS ({SPLIT_ROWS}), v AS ({vocabulary(DOCS)}),
enc AS (SELECT t.doc_id, list(v.id ORDER BY t.pos) AS ids FROM
  (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM
     (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '{{noise}}', '', 'g'), '{{blanks}}') AS a FROM parts)) t
  JOIN v USING (word) GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_idx) - 1 AS place, count(*) OVER (PARTITION BY split) AS n FROM parts),
dealt AS (SELECT split, doc_id, row_idx, CASE WHEN place < (n % 8) * (n // 8 + 1) THEN place // (n // 8 + 1)
            ELSE n % 8 + (place - (n % 8) * (n // 8 + 1)) // greatest(n // 8, 1) END AS worker FROM ranked),
placed AS (SELECT split, split || '/' || worker AS shard, row_idx, unnest(ids) AS id, generate_subscripts(ids, 1) AS p
           FROM dealt JOIN enc USING (doc_id)),
numbered AS (SELECT split, shard, id, row_number() OVER (PARTITION BY shard ORDER BY row_idx, p) - 1 AS ofs FROM placed),
made AS (SELECT split, shard, ofs // 1024 AS chunk, list(id ORDER BY ofs) AS ids FROM numbered GROUP BY ALL)
SELECT split, to_json({{{{'shard': shard, 'chunk': chunk, 'input_ids': ids,
  'attention_mask': list_transform(ids, lambda i: 1)}}}})::VARCHAR AS elem FROM made WHERE len(ids) = 1024
"""


def _packed():
    from tallymark.catalog.sql import BLANKS, NOISE

    return PACKED.replace("{noise}", NOISE).replace("{blanks}", BLANKS).replace("{{", "{").replace("}}", "}")


TALKS = f"""
SELECT to_json({{'conv_id': conv_id, 'messages': to_json(list({{'role': role, 'content': content}} ORDER BY turn))::VARCHAR}})::VARCHAR AS elem
FROM ({CONVERSATION}) GROUP BY conv_id"""

RESULTS = """
SELECT to_json({'grp': grp, 'task': task, 'n': n, 'correct': correct})::VARCHAR AS elem FROM (
WITH c AS (SELECT lang AS grp, lang || '-' || source AS task, doc_id, quality, unnest(range(4)) AS choice FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT grp, task, doc_id, any_value(quality) AS answer,
      list(choice ORDER BY (doc_id * 7919 + choice * 104729) % 10 DESC, choice)[1] AS choice FROM c GROUP BY ALL)
SELECT grp, task, count(*) AS n, sum(coalesce(choice = answer, false)::BIGINT)::BIGINT AS correct FROM m GROUP BY ROLLUP (grp, task))"""

ORACLES = {
    "proof_distribution": " UNION ALL ".join([
        evidence_sql("distribution", "dataset_hash", "train", DOC_ELEMENTS),
        _row("distribution", "results", "top_words", "sha256", "n", "h", TOP),
        _row("distribution", "results", "word_lengths", "chain", "n", "chain", _chain(LENGTHS))]),
    "proof_pretrain_data": " UNION ALL ".join([
        evidence_sql("pretrain", "dataset_hash", "", _packed(), "split"),
        _vocab_row("pretrain"), _settings_row("pretrain", "training_args"), _model_rows("pretrain", "model", "model")]),
    "proof_finetune_data": " UNION ALL ".join([
        evidence_sql("finetune", "dataset_hash", "train",
                     f"SELECT to_json({{'instruction': instruction, 'input': input, 'output': output, 'text': {PROMPT}}})::VARCHAR "
                     f"|| '#' || doc_id AS elem FROM ({INSTRUCTIONS})"),
        _settings_row("finetune", "training_args"), _vocab_row("finetune"),
        *[_model_rows("finetune", f"{m}_model", m) for m in ("base", "original", "finetuned")],
        *[_settings_row("finetune", f"{m}_model_config") for m in ("base", "original", "finetuned")]]),
    "proof_inference_data": " UNION ALL ".join([
        evidence_sql("inference", "conversation", "conversations", TALKS),
        _settings_row("inference", "inference_config"), _model_rows("inference", "model", "model")]),
    "proof_evaluation": " UNION ALL ".join([
        evidence_sql("eval", "dataset_hashes", "", "SELECT source || ':' || lang AS key, to_json({'text': text, 'quality': quality})::VARCHAR "
                     "|| '#' || doc_id AS elem FROM documents LEFT JOIN labels USING (doc_id)", "key"),
        evidence_sql("eval", "evaluation", "results", RESULTS), _settings_row("eval", "model_config"), _model_rows("eval", "model", "model"),
        _vocab_row("eval")]),
    "proof_evaluation_bleu": " UNION ALL ".join([
        evidence_sql("eval_bleu", "dataset_hashes", "train", "SELECT to_json({'de': source, 'en': replace(text, chr(10), ' ')})::VARCHAR "
                     "|| '#' || doc_id AS elem FROM documents"),
        _row("eval_bleu", "evaluation", "results_hash", "sha256", "NULL", "h",
             "SELECT sha256(to_json({'pred_len': pred_len, 'ref_len': ref_len, 'score': score})::VARCHAR) AS h FROM ("
             + bleu_sql("SELECT doc_id, replace(replace(text, chr(10), ' '), ' the ', ' a ') AS pred, replace(text, chr(10), ' ') AS ref "
                        "FROM documents") + ")"),
        _settings_row("eval_bleu", "model_config"), _model_rows("eval_bleu", "model", "model"), _vocab_row("eval_bleu")]),
}
