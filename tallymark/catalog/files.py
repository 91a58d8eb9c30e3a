"""Queries over files, shards and record tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tallymark.catalog.sql import COUNTS, state, table
from tallymark.operators.words import top_words, word_counts
from tallymark.session import fresh_path
from tallymark.sources import files, shards, tables

SHARD_MB = 0.25


def measured_file_scan(spark, sf_dir):
    """Digest of every table file."""
    found = files.file_digests(spark, sf_dir)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


def measured_stream_scan(spark, sf_dir):
    """The same digests by block-wise reading, as for files too large for memory."""
    found = files.file_digests(spark, sf_dir, whole_bytes=0)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


def decompressed_scan(spark, sf_dir):
    """Compressed text files, digested after decompression."""
    path = fresh_path(spark, "compressed")
    table(spark, sf_dir, "documents").select("text").write.option("compression", "gzip").text(path)
    return files.decompressed_digests(spark, path, pattern="*.gz").select("bytes", "sha256")


def measured_write(spark, sf_dir):
    """Write a table; the manifest comes from what landed."""
    path = fresh_path(spark, "written")
    return files.measured_write(table(spark, sf_dir, "documents"), path).select("bytes", "sha256")


def cumulative_files(spark, sf_dir):
    """One digest over all table files in path order."""
    return files.cumulative_digest(files.file_digests(spark, sf_dir)).select("n", "levels", "chain")


def _split_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("split", F.when(F.col("lang") == "en", "train").otherwise("test"))


def _written(spark, sf_dir):
    path = fresh_path(spark, "dataset")
    return path, shards.write_dataset(_split_documents(spark, sf_dir), path, "doc_id", SHARD_MB, "split")


def sharded_write(spark, sf_dir):
    """Shards of bounded size per split and their recorded manifest."""
    return _written(spark, sf_dir)[1].select("split", "shard_idx", "file", "rows")


def split_directory_scan(spark, sf_dir):
    """All rows of a stored dataset with their split."""
    path, _ = _written(spark, sf_dir)
    return shards.read_dataset(spark, path).select("split", "doc_id", "text", "lang", "source", "n_chars")


def stored_file_digests(spark, sf_dir):
    """Recorded against stored digests of every shard."""
    path, recorded = _written(spark, sf_dir)
    stored = shards.file_manifest(spark, path).withColumnsRenamed({"sha256": "stored", "bytes": "size"}).drop("file")
    both = recorded.join(stored, ["split", "shard_idx"], "full_outer")
    same = F.col("sha256").eqNullSafe(F.col("stored")) & F.col("bytes").eqNullSafe(F.col("size"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("shards"), F.bool_and(same).alias("unchanged"))


def dataset_loader(spark, sf_dir):
    """One split of a stored dataset."""
    path, _ = _written(spark, sf_dir)
    rows, _ = shards.load(spark, path, split="test", mode="row")
    return rows.select("doc_id", "text", "lang", "source", "n_chars")


def ranked_csv(spark, sf_dir):
    """The top words as CSV bytes and their digest."""
    return tables.ranked_csv(top_words(word_counts(table(spark, sf_dir, "documents"))))


def run_ledger(spark, sf_dir):
    """Run records appended to a ledger in two batches, then summed up."""
    path = fresh_path(spark, "ledger")
    events = table(spark, sf_dir, "events")
    columns = {name: F.lit(0) for name in (c.split()[0] for c in tables.LEDGER.split(", "))}
    columns |= {"attestation_type": F.col("event_type"), "model_path": F.concat(F.lit("model"), (F.col("user_id") % 3).cast("string")),
                "measure": F.lit(True), "in_memory": F.col("event_id") % 2 == 0, "total_access": F.col("event_id"),
                "compute_time": F.floor(F.col("value") * 100 + 0.5).cast("double")}
    records = events.select("event_id", *[c.alias(n) for n, c in columns.items()])
    half = F.col("event_id") % 2 == 0
    tables.append_ledger(records.where(half), path)
    whole = tables.append_ledger(records.where(~half), path)
    return tables.ledger_summary(whole).withColumn("deviation", F.round("deviation", 6))


def conversation_sink(spark, sf_dir):
    """Conversations written one per line and read back."""
    path = fresh_path(spark, "conversations")
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    tables.write_conversations(turns, path)
    back = spark.read.schema("conv_id bigint, messages array<struct<role:string,content:string>>").json(path)
    return back.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                       F.sha2(F.to_json("messages", {"ignoreNullFields": "false"}), 256).alias("sha256"))


def reviews_source(spark, sf_dir):
    """Texts and labels through the review CSV format."""
    path = fresh_path(spark, "reviews")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select(
        F.col("text").alias("review"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("sentiment"))
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
                   ignoreTrailingWhiteSpace=False)
    return tables.read_reviews(spark, path)


QUERIES = {f.__name__: f for f in (
    measured_file_scan, measured_stream_scan, decompressed_scan, measured_write, cumulative_files, sharded_write,
    split_directory_scan, stored_file_digests, dataset_loader, ranked_csv, run_ledger, conversation_sink, reviews_source)}

SPLIT = "CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END"

SHARDED = f"""
SELECT split, (dense_rank() OVER (PARTITION BY split ORDER BY raw) - 1)::INTEGER AS shard_idx, raw, doc_id FROM (
  SELECT split, doc_id, coalesce(sum(w) OVER (PARTITION BY split ORDER BY doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {int(SHARD_MB * (1 << 20))} AS raw
  FROM (SELECT {SPLIT} AS split, doc_id,
               8 + length('{{"doc_id":' || doc_id || '}}') + strlen(text) + strlen(lang) + strlen(source)
               + length('{{"n_chars":' || n_chars || '}}') + length({SPLIT}) AS w FROM documents))
"""

ORACLES = {
    "sharded_write": f"""
WITH s AS ({SHARDED}), c AS (SELECT split, count(DISTINCT shard_idx) AS k FROM s GROUP BY split)
SELECT split, shard_idx, split || '/' || printf('data-%05d-of-%05d.arrow', shard_idx, k) AS file, count(*) AS rows
FROM s JOIN c USING (split) GROUP BY split, shard_idx, k
""",
    "split_directory_scan": f"SELECT {SPLIT} AS split, doc_id, text, lang, source, n_chars FROM documents",
    "stored_file_digests": f"SELECT split, count(DISTINCT shard_idx) AS shards, true AS unchanged FROM ({SHARDED}) GROUP BY split",
    "dataset_loader": "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE lang <> 'en'",
    "ranked_csv": f"""
WITH top AS (SELECT *, row_number() OVER (ORDER BY n DESC, first_seen) AS rank FROM ({COUNTS}) ORDER BY rank LIMIT 10000),
b AS (SELECT count(*)::INTEGER AS n_lines, 'Rank,Word,Frequency' || chr(13) || chr(10)
      || string_agg(rank || ',' || word || ',' || n, chr(13) || chr(10) ORDER BY rank) || chr(13) || chr(10) AS csv FROM top)
SELECT n_lines, csv, sha256(csv) AS sha256 FROM b
""",
    "run_ledger": """
SELECT event_type AS attestation_type, 'model' || (user_id % 3) AS model_path, event_id % 2 = 0 AS in_memory,
       count(*) AS runs, avg(cents) AS mean, round(stddev_samp(cents), 6) AS deviation
FROM (SELECT *, floor(value * 100 + 0.5) AS cents FROM events) GROUP BY ALL
""",
    "conversation_sink": """
SELECT conv_id, count(*) AS n_messages,
       sha256(to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR) AS sha256
FROM conversations GROUP BY 1
""",
    "reviews_source": """
SELECT text AS review, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment
FROM documents JOIN labels USING (doc_id)
""",
}
