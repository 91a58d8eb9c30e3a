"""Quality rules: repeated words within a text, common lines across the texts of a host.

A line's normal form lower-cases A-Z, writes every digit as 0 and every run of
white space as one blank. A host's line is common if more than ``MAX_TEXTS``
different texts of the host hold it, whatever the host's size; exact copies
count once, they are not boilerplate. Common lines are removed, and a document
that keeps less than ``MIN_LEFT`` of its words is rejected as depleted.

Texts are read once and not moved; what is shuffled are narrow rows and 12
bytes a line. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialise

#: Different texts of a host above which a line is common there.
MAX_TEXTS = 20
#: Share of its words that a document must keep.
MIN_LEFT = 0.5
#: Words that a document must have, and percentage of repeated words it may have.
MIN_WORDS, MAX_REPEAT = 50, 50
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def normal_line(line: Column) -> Column:
    """A line in normal form."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.trim(F.regexp_replace(F.translate(line, upper + "123456789", lower + "0" * 9), BLANK, " "))


def _repeats(words: str, grams: str) -> Column:
    """Words inside 3-word windows that occur twice or more.

    ``grams`` are the windows' hashes. Sorted with their places, equal windows
    are neighbours; their places in order then tell how many words each adds.
    """
    order = F.sort_array(F.transform(F.col(grams), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), order)


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines`` of every row.

    ``lines`` has hash and words of every line with a word. A null text counts
    as empty, a null host is a host of its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), F.coalesce(F.concat(F.lit("0"), F.col(host).cast("string")), F.lit("1")).alias("host"), text.alias("text"))
    split = (base.withColumn("words", _words(F.col("text")))
             .withColumn("raw_lines", F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "")))
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - 3),
                        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    hashed = split.withColumn("grams", F.when(F.size("words") >= 4, grams).otherwise(F.array().cast("array<bigint>")))
    ordered = hashed.withColumn("ordered", _repeats("words", "grams"))
    twice = F.filter(F.col("ordered"), lambda x, i: (x["g"] == F.get("ordered", i - 1)["g"]) | (x["g"] == F.get("ordered", i + 1)["g"]))
    placed = ordered.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("places", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return placed.select(
        "doc_id", "host", F.xxhash64("text", F.length("text")).alias("text_hash"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.transform("raw_lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.size(_words(x)).alias("words"))).alias("lines"))


def common_lines(texts: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """``host, line`` of the common lines; ``texts`` has one row per different text of a host."""
    return (texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
              .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_texts).select("host", "line"))


def judge(docs: DataFrame, host: str = "source", max_texts: int = MAX_TEXTS, min_left: float = MIN_LEFT) -> DataFrame:
    """Measures of every row with ``removed_words, base_failed, kept``.

    Documents fail the base rules with fewer than ``MIN_WORDS`` words (so do
    empty and null texts) or more than ``MAX_REPEAT`` percent repeated words.
    Repeated rows are judged alike.
    """
    rows = materialise(measures(docs, host))
    texts = materialise(rows.groupBy("host", "text_hash").agg(F.first("lines").alias("lines")))
    common = materialise(common_lines(texts, max_texts))
    lines = texts.select("host", "text_hash", F.inline("lines")).join(common, ["host", "line"])
    removed = materialise(lines.groupBy("host", "text_hash").agg(F.sum("words").alias("removed_words")))
    judged = rows.drop("lines").join(removed, ["host", "text_hash"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("n_words") - F.col("removed_words") >= min_left * F.col("n_words")))


def without_common_lines(docs: DataFrame, host: str = "source", max_texts: int = MAX_TEXTS) -> DataFrame:
    """``docs`` with the common lines of their host taken out of ``text``; repeated rows stay repeated.

    Lines meet the common ones as hashes of their text, which then travel to
    the rows: at most the lines of one text for each row.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col(host).cast("string")), F.lit("1"))
    texts = materialise(measures(docs, host).groupBy("host", "text_hash").agg(F.first("lines").alias("lines")))
    hit = (texts.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
           .join(materialise(common_lines(texts, max_texts)), ["host", "line"])
           .groupBy("host", "text_hash").agg(F.collect_list("line").alias("common")))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("host"), F.xxhash64(text, F.length(text)).alias("text_hash"))
    joined = keyed.join(materialise(hit), ["host", "text_hash"], "left")
    kept = F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains("common", F.xxhash64(normal_line(x))) | (F.translate(x, BLANKS, "") == ""))
    left = F.when(F.col("common").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("text")
    return joined.select([left if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('0' || source, '1') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), grams AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM twice) GROUP BY r
), line AS (
  SELECT DISTINCT host, text, l, k, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS words FROM (
    SELECT host, text, k, raw, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
      'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS l
    FROM (SELECT host, text, unnest(lines) AS raw, generate_subscripts(lines, 1) AS k FROM w))
), common AS (
  SELECT host, l FROM line GROUP BY host, l HAVING count(DISTINCT text) > {MAX_TEXTS}
), removed AS (SELECT host, text, sum(words) AS n FROM line JOIN common USING (host, l) GROUP BY host, text
), measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    coalesce(removed.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN repeats USING (r) LEFT JOIN removed USING (host, text)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND n_words - removed_words >= {MIN_LEFT} * n_words AS kept
FROM measured
"""
