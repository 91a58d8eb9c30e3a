"""Registered queries of the operators of this subpackage, with SQL where it states the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import (alignment, bpe, centroids, extraction, fingerprints, mixing, partenum, quality, rules, secret_scan, sharding,
                           suffix_tree, warc)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, learned from the labels that are not held out."""
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.threshold(quality.score(docs.select("doc_id", "text"), model), 0.7)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    return bpe.code(documents(spark, sf_dir), bpe.public_vocabulary(), ("doc_id",), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes; equal texts stay together."""
    return sharding.assign(documents(spark, sf_dir), 16)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives written of it."""
    return warc.archive(pages(spark, sf_dir)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the fixed patterns' spans and those the learned field adds."""
    docs = documents(spark, sf_dir)
    found = secret_scan.scan(docs.select("doc_id", "text"), secret_scan.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, compared with each other and with the next document's."""
    return fingerprints.compare_with_edits(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures, common-line removal and verdict of every document."""
    return rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(pages(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weight takes of every document."""
    return mixing.taken(documents(spark, sf_dir))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets reach a Jaccard similarity of 0.9."""
    return partenum.components(documents(spark, sf_dir), size=3, num=90, den=100)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two vocabularies in every document, scored by the corpus-wide pair index."""
    return alignment.align(documents(spark, sf_dir))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the vectors after ten rounds."""
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a suffix tree learned from those that are not held out."""
    return suffix_tree.score(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_bpe, op3_sharding, op4_warc, op5_secret_scans, op6_fingerprints, op7_quality_rules,
                                   op8_html_extraction, op9_mixing, op10_ngram_join, op11_tokenizer_alignment, op12_centroid_clustering, op13_lm_scoring)}
ORACLES: dict[str, str] = {"op4_warc": warc.ORACLE, "op7_quality_rules": rules.ORACLE, "op12_centroid_clustering": centroids.ORACLE}
