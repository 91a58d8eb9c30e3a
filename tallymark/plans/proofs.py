"""Evidence of one step of a dataset's or model's life.

Each function takes the step's inputs as DataFrames, does the data work and
returns ``(evidence, outputs)``: an evidence table and the tables made on the
way. Pass a file manifest as ``files`` to name the input by its stored files;
otherwise the rows read are measured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.hashing import bytes_to_base64
from tallymark.functions.text import STOP_WORDS, cut_at_stop, extract_prediction, render_few_shot, render_prompt, translation_suffix
from tallymark.operators.chat import build_conversation, conversation_json, render_chat
from tallymark.operators.evidence import (bind, config_digest, evidence_rows, file_evidence, object_digest, rows_evidence,
                                          table_evidence, union_evidence)
from tallymark.operators.metrics import corpus_bleu, task_accuracy
from tallymark.operators.ordering import head_fraction, with_row_index
from tallymark.operators.sequences import pack, tokenize
from tallymark.operators.splits import split_random
from tallymark.operators.words import top_words, word_counts, word_lengths
from tallymark.session import materialise
from tallymark.sources.shards import write_dataset
from tallymark.sources.tables import ranked_csv

Proof = tuple[DataFrame, dict[str, DataFrame]]


def _input(df: DataFrame, proof: str, section: str, cols: Sequence[str], idx: str, files: DataFrame | None, algo: str) -> DataFrame:
    if files is not None:
        return file_evidence(files, proof, section)
    return rows_evidence(df, proof, section, cols, idx, algo=algo)


def _vocabulary(vocab: DataFrame, proof: str) -> DataFrame:
    placed = vocab.withColumn("pos", F.col("id").cast("bigint") - 1)
    return table_evidence(placed, proof, "tokenizer_hash", "vocabulary", ["word", "id"], "pos")


def _settings(settings: DataFrame, proof: str, section: str, name: str) -> DataFrame:
    return evidence_rows(config_digest(settings), proof, section, name, bytes_to_base64(F.col("sha256")), "sha256")


def _artifacts(manifest: DataFrame, proof: str, section: str) -> DataFrame:
    return evidence_rows(manifest, proof, section, F.col("file"), bytes_to_base64(F.col("sha256")), "sha256")


def _model(artifacts: DataFrame | None, vocab: DataFrame | None, proof: str) -> list[DataFrame]:
    parts = [] if artifacts is None else [_artifacts(artifacts, proof, "model")]
    return parts if vocab is None else [*parts, _vocabulary(vocab, proof)]


def contiguous_shard(place: Column, n: Column, shards: int) -> Column:
    """Shard of a row by its place among ``n``: runs whose lengths differ by at most one, the longer ones first."""
    least, more = F.floor(n / shards), n % shards
    long = more * (least + 1)
    rest = F.floor((place - long) / F.greatest(least, F.lit(1)))
    return F.when(place < long, F.floor(place / (least + 1))).otherwise(more + rest).cast("int")


def distribution(df: DataFrame, text: str = "text", idx: str = "doc_id", k: int = 10_000,
                 stop_words: Sequence[str] = STOP_WORDS, files: DataFrame | None = None, algo: str = "multiset",
                 proof: str = "distribution") -> Proof:
    """Word statistics of a corpus: top words and word lengths.

    The corpus is scanned once for its words; the table of distinct words is
    written down and read for both results.
    """
    df = df.select(idx, text)
    counts = materialise(word_counts(df, text, idx, stop_words))
    top, lengths = top_words(counts, k), word_lengths(counts)
    csv = ranked_csv(top)
    placed = with_row_index(lengths, "length")
    evidence = union_evidence([
        _input(df, proof, "dataset_hash", [text], idx, files, algo),
        evidence_rows(csv, proof, "results", "top_words", bytes_to_base64(F.col("sha256")), "sha256", F.col("n_lines")),
        table_evidence(placed, proof, "results", "word_lengths", ["length", "n_words"], "row_idx")])
    return evidence, {"top_words": top, "word_lengths": lengths, "csv": csv}


def preprocess(df: DataFrame, vocab: DataFrame, path: str, text: str = "text", idx: str = "doc_id", max_shard_mb: float = 500,
               divisor: int | None = None, files: DataFrame | None = None, algo: str = "multiset",
               proof: str = "preprocess") -> Proof:
    """Tokenize a corpus (or its first ``n // divisor`` rows) into a stored dataset."""
    df = df.select(idx, text)
    if divisor:
        df = head_fraction(with_row_index(df, idx), divisor).select(idx, text)
    tokens = tokenize(df, vocab, text, keep=(idx,))
    manifest = write_dataset(tokens, path, idx, max_shard_mb)
    evidence = union_evidence([
        _vocabulary(vocab, proof), file_evidence(manifest, proof, "output"),
        _input(df, proof, "dataset_hash", [text], idx, files, algo)])
    return evidence, {"tokens": tokens, "manifest": manifest}


def binding(manifest: DataFrame, stored: DataFrame, reads: DataFrame, cols: Sequence[str], idx: str, algo: str = "multiset",
            proof: str = "bind") -> Proof:
    """The files of a dataset and the rows read from them, bound together."""
    evidence = union_evidence([
        file_evidence(manifest, proof, "dataset_in_memory_hash"),
        rows_evidence(reads, proof, "dataset_memory_mapped_hash", cols, idx, by="split", algo=algo)])
    return evidence, {"binding": bind(manifest, stored, reads, cols, idx)}


def pretrain_data(df: DataFrame, vocab: DataFrame, settings: DataFrame, text: str = "text", idx: str = "doc_id",
                  rows: int = 25_000, test: float = 0.0015, seed: int = 0, shards: int = 8, size: int = 1024,
                  artifacts: DataFrame | None = None, algo: str = "multiset", proof: str = "pretrain") -> Proof:
    """First rows, random split, tokens and mask, chunks per shard; one digest per split.

    Every worker's shard is a run of consecutive rows of its split, the first
    ones a row longer where the rows do not divide evenly.
    """
    picked = with_row_index(df.select(idx, text), idx).where(F.col("row_idx") < rows)
    split = split_random(picked, idx, test, seed)
    tokens = materialise(tokenize(split, vocab, text, keep=("split", "row_idx")))
    placed = with_row_index(tokens, "row_idx", ["split"], "__place").join(
        F.broadcast(tokens.groupBy("split").agg(F.count(F.lit(1)).alias("__n"))), "split")  # two rows
    shard = F.concat_ws("/", "split", contiguous_shard(F.col("__place"), F.col("__n"), shards).cast("string"))
    placed = materialise(placed.withColumn("shard", shard).drop("__place", "__n"))
    chunks = pack(placed, "input_ids", "shard", "row_idx", size, aligned=["attention_mask"])
    chunks = chunks.withColumn("split", F.substring_index("shard", "/", 1))
    parts = [rows_evidence(chunks, proof, "dataset_hash", ["shard", "chunk", "input_ids", "attention_mask"], None, by="split", algo=algo),
             _vocabulary(vocab, proof), _settings(settings, proof, "configuration", "training_args")]
    if artifacts is not None:
        parts.append(_artifacts(artifacts, proof, "model"))
    return union_evidence(parts), {"chunks": chunks}


def finetune_data(df: DataFrame, settings: DataFrame, idx: str, end_token: str,
                  models: dict[str, tuple[DataFrame, DataFrame]] | None = None, vocab: DataFrame | None = None,
                  algo: str = "multiset", proof: str = "finetune") -> Proof:
    """Instruction rows ``(instruction, input, output)`` as training texts.

    ``models`` names the artifact and the settings of each model involved, such
    as ``base``, ``original`` and ``finetuned``.
    """
    formatted = df.withColumn("text", render_prompt("instruction", "input", "output", end_token))
    parts = [rows_evidence(formatted, proof, "dataset_hash", ["instruction", "input", "output", "text"], idx, algo=algo),
             _settings(settings, proof, "configuration", "training_args")]
    for name, (artifacts, config) in (models or {}).items():
        parts += [_artifacts(artifacts, proof, f"{name}_model"), _settings(config, proof, "configuration", f"{name}_model_config")]
    if vocab is not None:
        parts.append(_vocabulary(vocab, proof))
    return union_evidence(parts), {"formatted": formatted}


def inference_data(samples: DataFrame, replies: DataFrame, key: str, settings: DataFrame, artifacts: DataFrame | None = None,
                   algo: str = "multiset", proof: str = "inference") -> Proof:
    """Questions and cut replies as conversations."""
    cut = replies.withColumn("reply", cut_at_stop("reply"))
    turns = build_conversation(samples, cut, key)
    messages = conversation_json(turns, key)
    parts = [rows_evidence(messages, proof, "conversation", [key, "messages"], None, name="conversations", algo=algo),
             _settings(settings, proof, "configuration", "inference_config")]
    if artifacts is not None:
        parts.append(_artifacts(artifacts, proof, "model"))
    prompts = render_chat(turns, key, "turn", "role", "content")
    return union_evidence(parts), {"conversations": messages, "turns": turns, "prompts": prompts}


def evaluation(items: DataFrame, scores: DataFrame, gold: DataFrame, cols: Sequence[str], idx: str, settings: DataFrame,
               artifacts: DataFrame | None = None, vocab: DataFrame | None = None,
               algo: str = "multiset", proof: str = "eval") -> Proof:
    """Every task split's rows, and accuracy per task. ``items`` has task and split."""
    keyed = items.withColumn("key", F.concat_ws(":", "task", "split"))
    results = materialise(task_accuracy(scores, gold))
    parts = [rows_evidence(keyed, proof, "dataset_hashes", cols, idx, by="key", algo=algo),
             rows_evidence(results, proof, "evaluation", ["grp", "task", "n", "correct"], None, name="results", algo=algo),
             _settings(settings, proof, "configuration", "model_config")]
    return union_evidence(parts + _model(artifacts, vocab, proof)), {"results": results}


def evaluation_bleu(pairs: DataFrame, key: str, source: str, reference: str, generated: str, src_lang: str, ref_lang: str,
                    settings: DataFrame | None = None, artifacts: DataFrame | None = None, vocab: DataFrame | None = None,
                    algo: str = "multiset", proof: str = "eval_bleu") -> Proof:
    """Prompts, the predictions cut out of generated texts, and their score."""
    prompts = pairs.withColumn("prompt", render_few_shot(source, src_lang, ref_lang))
    cut = prompts.withColumn("prediction", extract_prediction(generated, translation_suffix(source, src_lang, ref_lang)))
    score = materialise(corpus_bleu(cut, key, "prediction", reference))
    results = score.select(object_digest(["pred_len", "ref_len", F.round("score", 6).alias("score")]).alias("h"))
    parts = [rows_evidence(pairs, proof, "dataset_hashes", [source, reference], key, algo=algo),
             evidence_rows(results, proof, "evaluation", "results_hash", bytes_to_base64(F.col("h")), "sha256")]
    if settings is not None:
        parts.append(_settings(settings, proof, "configuration", "model_config"))
    return union_evidence(parts + _model(artifacts, vocab, proof)), {"prompts": prompts, "predictions": cut, "score": score}


def quantization(original: DataFrame, quantized: DataFrame, settings: DataFrame, proof: str = "quantize") -> Proof:
    """Files of the original and the quantized artifact, and the settings used."""
    evidence = union_evidence([
        _artifacts(original, proof, "original_model"), _artifacts(quantized, proof, "quantized_model"),
        _settings(settings, proof, "configuration", "quantization_config")])
    return evidence, {}
