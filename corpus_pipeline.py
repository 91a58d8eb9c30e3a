"""Pipeline over ``documents``: quality, near duplicates, secrets, mix, tokens.

Each stage takes the documents its predecessor kept, written as Parquet, and
all but the last return the columns of ``documents``. Every decision of a stage
takes effect in what it returns:

* ``quality`` drops documents that the classifier predicts to be of low quality;
* ``near_duplicates`` keeps the document with the smallest id of every group of
  near duplicates (five-word shingles, Jaccard similarity of 0.8 or more) and
  every document without words;
* ``secrets`` replaces secrets in the texts;
* ``mix`` keeps the documents that the mix of sources takes words of; a text of
  which the mix takes other than all words once stays whole, it is an entry of
  the mix with its weight in the plan, which ``mixing.plan`` returns;
* ``tokens`` returns the ids of every text and what they decode to.

Rows without id pass the first four stages by the same rules; of several rows
with one id that survive duplicates all are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, mixing, partenum, quality, secret_scan
from tallymark.session import fresh_path

#: A near duplicate shares at least so many of a hundred shingles of so many words.
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model, 0.7)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return partenum.representatives(docs, SHINGLE_WORDS, SIMILARITY, 100)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    # the other columns wait in a struct, as the scan's own may have their names
    others = F.struct([F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others")
    found = secret_scan.scan(docs.select("text", others), secret_scan.fit(docs), redacted=True)
    return found.select([F.col("text") if c == "text" else F.col(f"others.`{c}`").alias(c) for c in docs.columns]).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources holds."""
    return mixing.in_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of them and of the text they decode to."""
    return bpe.code(docs, bpe.public_vocabulary(), ("doc_id", "source"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", quality_stage), ("near_duplicates", duplicate_stage), ("secrets", secret_stage), ("mix", mix_stage),
          ("tokens", token_stage)]

#: SQL cannot train or apply the models of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = fresh_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
