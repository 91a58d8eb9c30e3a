"""Queries over row positions, selections and splits."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tallymark.catalog.sql import table
from tallymark.operators import ordering, splits, workers


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def row_index(spark, sf_dir):
    """Dense positions over a key with gaps."""
    return ordering.with_row_index(table(spark, sf_dir, "labels"), "doc_id").select("row_idx", "doc_id", "quality")


def row_index_per_group(spark, sf_dir):
    """Dense positions within every language."""
    rows = ordering.with_row_index(_docs(spark, sf_dir), "doc_id", within=["lang"])
    return rows.select("lang", "row_idx", "doc_id")


def customer_order_index(spark, sf_dir):
    """Dense positions over a two-part key."""
    orders = table(spark, sf_dir, "orders")
    return ordering.with_row_index(orders, ["o_custkey", "o_orderkey"]).select("row_idx", "o_custkey", "o_orderkey")


def head_by_position(spark, sf_dir):
    """The first 25,000 rows."""
    rows = ordering.with_row_index(table(spark, sf_dir, "orders"), "o_orderkey")
    return ordering.head(rows, 25_000).select("row_idx", "o_orderkey")


def head_fraction(spark, sf_dir):
    """The first hundredth of the rows."""
    rows = ordering.with_row_index(table(spark, sf_dir, "orders"), "o_orderkey")
    return ordering.head_fraction(rows, 100).select("row_idx", "o_orderkey")


def keep_columns(spark, sf_dir):
    """Only the text column."""
    return ordering.keep_columns(_docs(spark, sf_dir), ["text"])


def random_split(spark, sf_dir):
    """A repeatable split with 0.15 % test rows."""
    return splits.split_random(table(spark, sf_dir, "orders"), "o_orderkey", 0.0015, seed=7).select("o_orderkey", "split")


def threshold_split(spark, sf_dir):
    """The one-pass split of approximate size."""
    return splits.split_by_threshold(_docs(spark, sf_dir), "doc_id", 0.25, seed=7).select("doc_id", "split")


def stratified_split(spark, sf_dir):
    """Half of every language and source."""
    out = splits.split_stratified(_docs(spark, sf_dir), "doc_id", ["lang", "source"], 0.5, seed=0)
    return out.select("doc_id", "lang", "source", "split")


def concatenate_shards(spark, sf_dir):
    """Shards appended in order, with positions over the whole."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    langs = [r.lang for r in docs.select("lang").distinct().orderBy("lang").collect()]  # nulls first; each is one shard
    parts = [docs.where(F.col("lang").eqNullSafe(F.lit(lang))) for lang in langs]
    return ordering.concatenate(parts, "doc_id").select("row_idx", "shard_idx", "doc_id")


def membership_filter(spark, sf_dir):
    """Rows whose category is in a fixed list."""
    kept = ordering.keep_values(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "HOUSEHOLD"])
    return kept.select("c_custkey", "c_mktsegment")


def null_fill(spark, sf_dir):
    """Missing labels become their own category."""
    joined = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return ordering.fill_missing(joined.select("doc_id", F.col("quality").cast("string").alias("quality")))


def batched_map(spark, sf_dir):
    """A Python function over batches of rows."""
    def measure(batch):
        return {"doc_id": batch["doc_id"], "chars": [len(t) for t in batch["text"]],
                "lines": [t.count("\n") + 1 for t in batch["text"]]}

    return ordering.map_batches(_docs(spark, sf_dir), measure, "doc_id bigint, chars bigint, lines bigint",
                                batch_size=1000, keep=["doc_id", "text"])


def sequential_batches(spark, sf_dir):
    """Batches of 32 rows in position order; the short last one is dropped."""
    rows = ordering.with_row_index(table(spark, sf_dir, "labels"), "doc_id")
    return ordering.read_batches(rows, 32, drop_last=True).select("batch_id", "row_idx", "doc_id")


def _measure(batches):
    """Characters and lines of each document; the task's state adds them up."""
    n = empty = lines = longest = 0
    for batch in batches:
        text = batch.column("text")
        chars, count = pc.utf8_length(text), pc.add(pc.count_substring(text, "\n"), 1)
        n, empty = n + batch.num_rows, empty + text.null_count
        lines, longest = lines + (pc.sum(count).as_py() or 0), max(longest, pc.max(chars).as_py() or 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), chars, count], names=["doc_id", "chars", "lines"])
    return {"n": n, "nulls": empty, "lines": lines, "longest": longest}


def _worker(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return workers.map_with_state(docs, _measure, "doc_id bigint, chars bigint, lines bigint", "n bigint, nulls bigint, lines bigint, longest bigint")


def worker_rows(spark, sf_dir):
    """Rows that a function with a state returns."""
    return _worker(spark, sf_dir)[0]


def worker_state(spark, sf_dir):
    """The states that it leaves in every task, merged."""
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "nulls", "lines")]
    return _worker(spark, sf_dir)[1].agg(*total, F.max("longest").alias("longest"))


QUERIES = {f.__name__: f for f in (
    row_index, row_index_per_group, customer_order_index, head_by_position, head_fraction, keep_columns, random_split,
    threshold_split, stratified_split, concatenate_shards, membership_filter, null_fill, batched_map, sequential_batches, worker_rows, worker_state)}


def _rank(order: str, within: str = "") -> str:
    return f"row_number() OVER ({f'PARTITION BY {within} ' if within else ''}ORDER BY {order}) - 1"


ORACLES = {
    "worker_rows": "SELECT doc_id, length(text)::BIGINT AS chars, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents",
    "worker_state": """
SELECT count(*) AS n, count(*) FILTER (text IS NULL) AS nulls, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines,
       max(length(text))::BIGINT AS longest FROM documents""",
    "row_index": f"SELECT {_rank('doc_id')} AS row_idx, doc_id, quality FROM labels",
    "row_index_per_group": f"SELECT lang, {_rank('doc_id', 'lang')} AS row_idx, doc_id FROM documents",
    "customer_order_index": f"SELECT {_rank('o_custkey, o_orderkey')} AS row_idx, o_custkey, o_orderkey FROM orders",
    "head_by_position": f"SELECT * FROM (SELECT {_rank('o_orderkey')} AS row_idx, o_orderkey FROM orders) WHERE row_idx < 25000",
    "head_fraction": f"""SELECT * FROM (SELECT {_rank('o_orderkey')} AS row_idx, o_orderkey FROM orders)
                         WHERE row_idx < (SELECT count(*) // 100 FROM orders)""",
    "keep_columns": "SELECT text FROM documents",
    "random_split": f"""
SELECT o_orderkey, CASE WHEN {_rank("sha256('7:' || o_orderkey)")} < ceil(0.0015::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END
       AS split FROM orders""",
    "threshold_split": """
SELECT doc_id, CASE WHEN substr(sha256('7:' || doc_id), 1, 8) < '40000000' THEN 'test' ELSE 'train' END AS split FROM documents""",
    "stratified_split": f"""
SELECT doc_id, lang, source, CASE WHEN {_rank("sha256('0:' || doc_id)", 'lang, source')}
       < ceil(0.5::DOUBLE * count(*) OVER (PARTITION BY lang, source)) THEN 'test' ELSE 'train' END AS split FROM documents""",
    "concatenate_shards": f"""
SELECT {_rank('shard_idx, doc_id')} AS row_idx, shard_idx, doc_id
FROM (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS shard_idx FROM documents)""",
    "membership_filter": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')",
    "null_fill": "SELECT doc_id, coalesce(quality::VARCHAR, 'Unknown') AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "batched_map": "SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents",
    "sequential_batches": f"""
SELECT row_idx // 32 AS batch_id, row_idx, doc_id FROM (SELECT {_rank('doc_id')} AS row_idx, doc_id FROM labels)
WHERE row_idx // 32 < (SELECT count(*) // 32 FROM labels)""",
}
