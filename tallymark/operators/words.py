"""Word statistics and vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import STOP_WORDS, clean_tokens, is_counted_word, word_runs
from tallymark.operators.ordering import running_offset
from tallymark.session import materialise

INTEGERS = ("byte", "short", "integer", "long")
POSITIONS = 1 << 32
#: Words that one task may rank.
DIRECT = 100_000


def _occurrence(idx: Column, pos: Column) -> Column:
    """Order of an occurrence in the corpus as one number that holds any long and any position.

    A number, unlike a struct, keeps the aggregation a hash aggregation.
    """
    return idx.cast("decimal(19,0)") * F.lit(POSITIONS).cast("decimal(10,0)") + pos.cast("decimal(10,0)")


def words(df: DataFrame, text: str = "text", idx: str = "doc_id",
          stop_words: Sequence[str] = STOP_WORDS, extra: Sequence[str] = ()) -> DataFrame:
    """``(idx, pos, word)``: one row per counted word of every text."""
    runs = df.select(idx, *extra, F.posexplode(word_runs(text)).alias("pos", "word"))
    return runs.where(is_counted_word(F.col("word"), stop_words))


def count_tokens(tokens: DataFrame, idx: str = "doc_id") -> DataFrame:
    """``(word, n, first_seen)`` of a table of occurrences.

    ``first_seen`` is a ``decimal(30,0)`` wherever ids are integers of any size
    and sign, and a struct of id and position for ids of other types.
    """
    whole = tokens.schema[idx].dataType.typeName() in INTEGERS
    order = _occurrence(F.col(idx), F.col("pos")) if whole else F.struct(idx, "pos")
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))


def word_counts(df: DataFrame, text: str = "text", idx: str = "doc_id",
                stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Corpus-wide count of every word and where it was seen first."""
    return count_tokens(words(df, text, idx, stop_words), idx)


def _steps_down_to(counts: DataFrame, k: int) -> DataFrame:
    """The rows from the highest count steps that together hold ``k`` rows or more.

    A step is an eighth of a power of two, so the histogram that reaches the
    driver has at most 512 rows.
    """
    step = F.floor(8 * F.log2("n"))
    held, least = 0, None
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        held, least = held + row["count"], row["step"]
        if held >= k:
            break
    return counts if least is None else counts.where(step >= least)


def top_words(counts: DataFrame, k: int = 10_000) -> DataFrame:
    """``(rank, word, n)`` of the ``k`` most frequent words, ties first-seen.

    Up to ``DIRECT`` words are sorted in one task. Beyond, the count steps that
    can hold the top are selected, and ranks are prefix sums over (count, id,
    position), so no task holds more than a bucket of them.
    """
    integers = counts.schema["first_seen"].dataType.typeName() == "decimal"
    if k <= DIRECT or not integers:
        order = [F.col("n").desc(), F.col("first_seen")]
        top = counts.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select("rank", "word", "n")
    found = _steps_down_to(materialise(counts), k)
    pos = F.pmod("first_seen", F.lit(POSITIONS))
    keys = {"__n": -F.col("n"), "__id": ((F.col("first_seen") - pos) / POSITIONS).cast("decimal(19,0)").cast("bigint"), "__pos": pos.cast("bigint")}
    placed = running_offset(found.withColumns(keys), list(keys), name="rank")
    return placed.where(F.col("rank") < k).select((F.col("rank") + 1).alias("rank"), "word", "n")


def word_lengths(counts: DataFrame) -> DataFrame:
    """``(length, n_words)`` over the distinct words."""
    return counts.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n_words"))


def clean_occurrences(df: DataFrame, text: str = "text", idx: str = "doc_id",
                      stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``(idx, pos, word)`` of the cleaned tokens that may enter a vocabulary."""
    runs = df.select(idx, F.posexplode(clean_tokens(text)).alias("pos", "word"))
    return runs.where((F.col("word") != "") & ~F.col("word").isin(list(stop_words)))


def vocabulary(df: DataFrame, text: str = "text", idx: str = "doc_id", k: int = 1000,
               stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``(word, id)``: the ``k`` most frequent cleaned tokens, ids from 1."""
    counts = count_tokens(clean_occurrences(df, text, idx, stop_words), idx)
    return top_words(counts, k).select("word", F.col("rank").cast("int").alias("id"))


def vocabulary_difference(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("section", "token"),
                          value: str = "value") -> DataFrame:
    """``(section, missing, extra, changed, same)`` counts between two tokenizers.

    Each side is a table of sections (vocabulary, special tokens, settings),
    tokens and values.
    """
    keys = list(keys)
    a = left.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    b = right.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    both = a.join(b, keys, "full_outer")
    kind = (F.when(F.col("__in_b").isNull(), "missing").when(F.col("__in_a").isNull(), "extra")
            .when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed"))
    counted = both.select(keys[0], kind.alias("__kind")).groupBy(keys[0])
    return counted.agg(*[F.count(F.when(F.col("__kind") == k, 1)).alias(k) for k in ("missing", "extra", "changed", "same")])


def tokenizers_equal(difference: DataFrame, order: Sequence[str] = ("vocabulary", "special", "settings")) -> DataFrame:
    """One row ``(equal, first_difference)``; sections are compared in order."""
    differs = (F.col("missing") + F.col("extra") + F.col("changed")) > 0
    at = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("section"))
    first = F.min_by(F.when(differs, F.col("section")), F.when(differs, at))
    return difference.agg((F.count(F.when(differs, 1)) == 0).alias("equal"), first.alias("first_difference"))
