"""Corpus BLEU and task accuracy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.text import BLANKS, _column
from tallymark.session import materialise

SLICE_BYTES = 1 << 20

def _filled(text: str | Column) -> Column:
    return F.coalesce(_column(text), F.lit(""))


def blank_tokens(text: str | Column) -> Column:
    """Tokens between blanks."""
    return F.filter(F.split(_filled(text), BLANKS), lambda t: t != "")


# Split off symbols, then . and , unless between digits, then a dash after a digit. The rules also put
# blanks around each blank, which changes no token and is left out, as it would be most of the matches.
EVALUATION_RULES = ((r"([\x{7b}-\x{7e}\x{5b}-\x{60}\x{21}-\x{26}\x{28}-\x{2b}\x{3a}-\x{40}\x{2f}])", r" \1 "),
                    (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "))


def _split_at_blanks(texts: pa.Array) -> pa.ListArray:
    return pc.split_pattern_regex(texts, BLANKS)


def _split_by_rules(texts: pa.Array) -> pa.ListArray:
    for found, put in EVALUATION_RULES:
        texts = pc.replace_substring_regex(texts, found, put)
    return _split_at_blanks(texts)


def _unescaped(text: str | Column) -> Column:
    out = _filled(text)
    for found, put in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"),
                       ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(found), F.lit(put))
    return F.concat(F.lit(" "), out, F.lit(" "))


def evaluation_tokens(text: str | Column) -> Column:
    """Tokens by the public mteval v13a rules for western languages."""
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(texts: pa.Array) -> pa.Array:
        return _split_by_rules(texts)

    return F.filter(split(_unescaped(text)), lambda t: t != "")


# What is done to a text before it leaves the JVM, and how a task cuts it; empty tokens do not count. The regular
# expressions run in Arrow: Java's, one after another, take several times as long.
TOKENIZERS = {"blank": (_filled, _split_at_blanks), "13a": (_unescaped, _split_by_rules)}


def clipped_counts(pred: pa.ListArray, ref: pa.ListArray, max_n: int) -> np.ndarray:
    """Rows ``(matches, total, ref_total)`` for n-grams of 1 to ``max_n`` tokens, over all pairs.

    An n-gram is numbered by its pair, the number of its first tokens and its
    last token, so equal numbers are equal n-grams of one pair.
    """
    tokens = pa.concat_arrays([pred.flatten(), ref.flatten()])
    filled = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)
    sizes = np.concatenate([side.value_lengths().to_numpy() for side in (pred, ref)])
    text = np.repeat(np.arange(len(sizes)), sizes)[filled]
    tokens = tokens.dictionary_encode()
    ids, known = tokens.indices.to_numpy().astype("int64")[filled], len(tokens.dictionary)
    at, end = np.arange(len(ids)), np.searchsorted(text, text, side="right")
    split, gram, out = np.searchsorted(text, len(pred)), text % max(len(pred), 1), []
    for n in range(1, max_n + 1):
        whole = at + n <= end[at]
        at, gram = at[whole], gram[whole]
        gram, found = pd.factorize(gram * known + ids[at + n - 1])
        p, r = (np.bincount(gram[side], minlength=len(found)) for side in (at < split, at >= split))
        out.append((np.minimum(p, r).sum(), p.sum(), r.sum()))
    return np.array(out, dtype="int64")


def ngram_statistics(pairs: DataFrame, key: str, pred: str, ref: str, max_n: int = 4,
                     tokenizer: str = "13a") -> DataFrame:
    """``(order, matches, total, ref_total)`` per n-gram length.

    Counts are clipped within each pair; ``key`` is unique. A pair is one row,
    so its n-grams are counted where it is read: sums travel, no text and no
    n-gram does. A task counts some ``SLICE_BYTES`` of texts at a time.
    """
    prepare, cut = TOKENIZERS[tokenizer]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((max_n, 3), dtype="int64")
        for batch in batches:
            sides = batch.column(0), batch.column(1)
            upto = np.cumsum(sum(pc.binary_length(side).to_numpy().astype("int64") for side in sides))
            starts = [0, *(np.flatnonzero(np.diff(upto // SLICE_BYTES)) + 1), batch.num_rows]
            for start, stop in zip(starts, starts[1:]):
                sums += clipped_counts(*[cut(side.slice(start, stop - start)) for side in sides], max_n)
        columns = [np.arange(1, max_n + 1, dtype="int32"), *sums.T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["order", "matches", "total", "ref_total"])

    texts = pairs.select(prepare(pred).alias("pred"), prepare(ref).alias("ref"))
    counts = texts.mapInArrow(count, "order int, matches bigint, total bigint, ref_total bigint")
    sums = counts.groupBy("order").agg(*[F.sum(c).alias(c) for c in ("matches", "total", "ref_total")])
    return sums.where((F.col("total") > 0) | (F.col("ref_total") > 0))


def corpus_bleu(pairs: DataFrame, key: str, pred: str, ref: str, max_n: int = 4, tokenizer: str = "13a",
                smooth: str = "exp") -> DataFrame:
    """One row ``(score, brevity, pred_len, ref_len, precisions)``, 0..100.

    ``smooth`` is ``exp`` (halving value for each n without a match) or
    ``none``.
    """
    if smooth not in ("exp", "none"):
        raise ValueError(f"unknown smoothing {smooth!r}")
    stats = ngram_statistics(pairs, key, pred, ref, max_n, tokenizer)
    per_n = [F.coalesce(F.max(F.when(F.col("order") == n, F.col(c))), F.lit(0)).cast("double").alias(f"{c}{n}")
             for n in range(1, max_n + 1) for c in ("matches", "total")]
    ref_len = F.coalesce(F.max(F.when(F.col("order") == 1, F.col("ref_total"))), F.lit(0)).alias("ref_len")
    row = stats.agg(*per_n, ref_len)
    halvings, precisions = F.lit(0.0), []
    for n in range(1, max_n + 1):
        hit, total = F.col(f"matches{n}"), F.col(f"total{n}")
        if smooth == "exp":
            halvings = halvings + F.when((hit == 0) & (total > 0), 1.0).otherwise(0.0)
            missed = F.lit(100.0) / (F.pow(F.lit(2.0), halvings) * total)
        else:
            missed = F.lit(0.0)
        precisions.append(F.when(total == 0, 0.0).when(hit == 0, missed).otherwise(F.lit(100.0) * hit / total))
    length = F.col("total1")
    brevity = F.when(length == 0, 0.0).when(length < F.col("ref_len"), F.exp(1 - F.col("ref_len") / length)).otherwise(1.0)
    logs, usable, any_hit = F.lit(0.0), F.lit(True), F.lit(False)
    for n, p in enumerate(precisions, 1):
        logs, usable, any_hit = logs + F.log(p), usable & (p > 0), any_hit | (F.col(f"matches{n}") > 0)
    score = F.when(usable & any_hit, brevity * F.exp(logs / max_n)).otherwise(0.0)
    return row.select(score.alias("score"), brevity.alias("brevity"), length.cast("bigint").alias("pred_len"),
                      F.col("ref_len").cast("bigint").alias("ref_len"), F.array(*precisions).alias("precisions"))


def chosen_answers(scores: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., choice)``: the best-scored choice, the first one on a tie."""
    best = F.max(F.struct("score", (-F.col("choice")).alias("c"))).alias("best")
    return scores.groupBy(*keys).agg(best).select(*keys, (-F.col("best.c")).alias("choice"))


def task_accuracy(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """``(grp, task, n, correct, accuracy)`` per task, group and overall.

    ``scores`` is ``(grp, task, item, choice, score)`` and ``gold``
    ``(task, item, answer)``. A null task is its group's size-weighted mean,
    a null group that of all items. A gold item without scores counts as wrong
    in every group that scores its task; a task that no group scores belongs to
    the group ``unscored``.
    """
    chosen = chosen_answers(scores, ["grp", "task", "item"])
    groups = scores.select("grp", "task").distinct()
    expected = gold.join(groups, "task", "left").withColumn("grp", F.coalesce("grp", F.lit("unscored")))
    marked = expected.join(chosen, ["grp", "task", "item"], "left").withColumn(
        "hit", F.coalesce(F.col("choice") == F.col("answer"), F.lit(False)).cast("int"))
    per_task = marked.groupBy("grp", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("correct"))
    rolled = per_task.rollup("grp", "task").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))
    return rolled.withColumn("accuracy", F.col("correct") / F.col("n"))


def flatten_tasks(tree: DataFrame) -> DataFrame:
    """``(grp, task)``: the leaf tasks below every root of a ``(parent, child)`` tree.

    Each level is written down once and the walk ends with the first empty one,
    so nesting has no bound. A pair of root and task is walked once, which also
    ends cycles below a root.
    """
    tree = materialise(tree.select("parent", "child").distinct())
    parents = tree.select(F.col("parent").alias("task")).distinct()
    roots = tree.join(tree.select(F.col("child").alias("parent")), "parent", "left_anti")
    level = materialise(roots.select(F.col("parent").alias("grp"), F.col("child").alias("task")).distinct())
    seen = level
    edges = tree.select(F.col("parent").alias("task"), F.col("child").alias("__next"))
    while not level.isEmpty():
        below = level.join(edges, "task").select("grp", F.col("__next").alias("task")).distinct()
        level = materialise(below.join(seen, ["grp", "task"], "left_anti"))
        seen = materialise(seen.unionByName(level))
    return seen.join(parents, "task", "left_anti").select("grp", "task")
