"""Pieces of DuckDB SQL shared by the oracles, and table reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.functions.text import STOP_WORDS
from tallymark.session import spread


# Tables large enough to be worth spreading, with the column to spread by.
SPREAD = {"documents": "doc_id", "lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id",
          "embeddings": "vec_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, SPREAD[name]) if name in SPREAD else df


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOPS = "(" + ", ".join(literal(w) for w in STOP_WORDS) + ")"

# Word runs of every document with their position.
RUNS = r"""
SELECT doc_id, lang, unnest(a) AS word, generate_subscripts(a, 1) - 1 AS pos
FROM (SELECT doc_id, lang, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+') AS a FROM documents)
"""

WORDS = f"""
SELECT doc_id, lang, pos, word FROM ({RUNS})
WHERE regexp_full_match(word, '[a-z]{{2,}}') AND word NOT IN {STOPS}
"""

COUNTS = f"""
SELECT word, count(*) AS n, min(doc_id * 67108864 + pos) AS first_seen FROM ({WORDS}) GROUP BY word
"""

NOISE = r"[^\p{L}\p{Nl}\p{No}_\t-\r\x1c-\x20\x{85}\p{Z}]+"
BLANKS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"


def cleaned(source: str) -> str:
    """Cleaned tokens of a table ``(doc_id, text)``; empty ones included."""
    return f"""
SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) - 1 AS pos
FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '{NOISE}', '', 'g'), '{BLANKS}') AS a
      FROM ({source}))
"""


def vocabulary(source: str, k: int = 1000) -> str:
    return f"""
SELECT word, row_number() OVER (ORDER BY n DESC, first_seen) AS id FROM (
  SELECT word, count(*) AS n, min(doc_id * 67108864 + pos) AS first_seen
  FROM ({cleaned(source)}) WHERE word <> '' AND word NOT IN {STOPS} GROUP BY word)
ORDER BY n DESC, first_seen LIMIT {k}
"""


def encoded(docs: str, vocab: str) -> str:
    """``(doc_id, ids)`` with ids a list, empty where no word is known."""
    return f"""
SELECT d.doc_id, coalesce(e.ids, []) AS ids FROM ({docs}) d LEFT JOIN (
  SELECT t.doc_id, list(v.id ORDER BY t.pos) AS ids FROM ({cleaned(docs)}) t JOIN ({vocab}) v USING (word) GROUP BY t.doc_id
) e USING (doc_id)
"""


def state(elements: str, by: tuple = (), signed: bool = False, times: int = 1) -> str:
    """Multiset state of a query giving ``by..., elem[, sign]``."""
    cols = "".join(f"{c}, " for c in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    sign = "sign * " if signed else ""
    sums = ", ".join(f"coalesce(sum({sign}('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT::HUGEINT), 0) * {times} AS s{i}"
                     for i in range(8))
    n = f"coalesce(sum(sign), 0) * {times}" if signed else f"count(*) * {times}"
    steps, carry = [], "0"
    for i in reversed(range(8)):
        total = f"(s{i} + {carry})"
        steps.append(f"(({total} % 4294967296) + 4294967296) % 4294967296 AS d{i}")
        steps.append(f"({total} - d{i}) // 4294967296 AS k{i}")
        carry = f"k{i}"
    out = ", ".join(f"d{i}::BIGINT AS l{i}" for i in range(8))
    extra = ", sign" if signed else ""
    return (f"SELECT {cols}n::BIGINT AS n, k0::BIGINT AS hi, {out} FROM (SELECT *, {', '.join(steps)} FROM ("
            f"SELECT {cols}{n} AS n, {sums} FROM (SELECT {cols}sha256(elem) AS h{extra} FROM ({elements})){group}))")


STATE_HEX = "printf('%x', hi) || " + " || ".join(f"printf('%08x', l{i})" for i in range(8))


def trimmed_base64(hex_sql: str) -> str:
    digits = f"regexp_replace({hex_sql}, '^0+', '')"
    return f"to_base64(unhex(CASE WHEN length({digits}) % 2 = 1 THEN '0' || {digits} ELSE {digits} END))"


def element(table_sql: str, cols: tuple, idx: str, keep: str = "") -> str:
    fields = ", ".join(f"{literal(c)}: {c}" for c in cols)
    return f"SELECT {keep}to_json({{{fields}}})::VARCHAR || '#' || {idx} AS elem FROM ({table_sql})"


def chain(rows: str, block: int, levels: int) -> str:
    """Root of the block chain over ``(i, h)`` rows with dense ``i`` from 0."""
    step = "list_reduce(list_prepend('none', list(h ORDER BY i)), lambda acc, x: sha256(x || acc))"
    parts = [f"c0 AS MATERIALIZED (SELECT i // {block} AS i, count(*) AS n, {step} AS h FROM ({rows}) GROUP BY 1)"]
    for k in range(1, levels):
        parts.append(f"c{k} AS MATERIALIZED (SELECT i // {block} AS i, sum(n) AS n, {step} AS h FROM c{k - 1} GROUP BY 1)")
    picks = " UNION ALL ".join(f"SELECT {k} AS lvl, n, h FROM c{k} WHERE (SELECT count(*) FROM c{k}) = 1" for k in range(levels))
    return (f"WITH {', '.join(parts)} SELECT n::BIGINT AS n, (lvl + 1)::INTEGER AS levels, h AS chain "
            f"FROM ({picks}) ORDER BY lvl LIMIT 1")


def chains(rows: str, block: int, levels: int) -> str:
    """Root of the block chain of every ``key`` over ``(key, i, h)`` rows with dense ``i`` from 0 in each."""
    step = "list_reduce(list_prepend('none', list(h ORDER BY i)), lambda acc, x: sha256(x || acc))"
    parts = [f"c0 AS MATERIALIZED (SELECT key, i // {block} AS i, count(*) AS n, {step} AS h FROM ({rows}) GROUP BY 1, 2)"]
    for k in range(1, levels):
        parts.append(f"c{k} AS MATERIALIZED (SELECT key, i // {block} AS i, sum(n) AS n, {step} AS h FROM c{k - 1} GROUP BY 1, 2)")
    picks = " UNION ALL ".join(f"SELECT {k} AS lvl, * FROM c{k} QUALIFY count(*) OVER (PARTITION BY key) = 1" for k in range(levels))
    return (f"WITH {', '.join(parts)} SELECT key, n::BIGINT AS n, (lvl + 1)::INTEGER AS levels, h AS chain "
            f"FROM ({picks}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY lvl) = 1")
