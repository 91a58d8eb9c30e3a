"""Run registered queries beside their SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


SECONDS = {"spark": 0.0}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return v


def kind(v):
    return {int: "n", float: "f", Decimal: "d"}.get(type(v), type(v).__name__)


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(value(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(value(row[i]) for i in order) for row in cur.fetchall()]


def difference(spark, con, fn, sql, sf_dir):
    """None when equal, else a short text."""
    begin = time.time()
    names, got = spark_rows(fn(spark, sf_dir))
    SECONDS["spark"] = time.time() - begin
    if sql is None:
        return None if got else "no rows"
    want_names, want = duck_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got and want:
        kinds = [(kind(a), kind(b)) for a, b in zip(got[0], want[0]) if a is not None and b is not None]
        if any(a != b for a, b in kinds):
            return f"types {kinds}"
    a, b = Counter(got), Counter(want)
    if a != b:
        return f"{len(got)} rows vs {len(want)}; only spark {str(list((a - b).items())[:2])[:400]}; only sql {str(list((b - a).items())[:2])[:400]}"
    return None


def main():
    from pyspark.sql import SparkSession

    from tallymark.catalog import all_oracles, all_queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, oracles = connect(sf_dir), all_oracles()
    for name, fn in all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            result = difference(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok " if result is None else "BAD"
        print(mark, name, "" if name in oracles else "(rows only)", f"spark {SECONDS['spark']:.1f}s", f"both {time.time() - start:.1f}s", result or "", flush=True)


if __name__ == "__main__":
    main()
