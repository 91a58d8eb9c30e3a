"""Tabular features: indicators, sensitive attributes, aligned column groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.ordering import with_row_index
from tallymark.session import bounded_rows, join_small, materialise

#: Indicator columns of the wide form; ``sparse_one_hot`` takes any number of categories.
MAX_CATEGORIES = 10_000


def binarise(**conditions: Column) -> list[Column]:
    """Conditions as 0/1 columns of the given names; a null condition counts 0."""
    return [F.coalesce(c, F.lit(False)).cast("int").alias(name) for name, c in conditions.items()]


def label_encode(label: str, positive: str = "positive", name: str = "y") -> Column:
    """1 for the positive label, else 0."""
    return F.coalesce(F.col(label) == positive, F.lit(False)).cast("int").alias(name)


def categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted categories of the columns, found in one pass."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                                          for c in cols])).alias("p")).select("p.*").where("value is not null").distinct()
    found = {c: [] for c in cols}
    for row in bounded_rows(pairs, MAX_CATEGORIES, "categories"):
        found[row["col"]].append(row["value"])
    return {c: sorted(values) for c, values in found.items()}


def one_hot(df: DataFrame, cols: Sequence[str], numeric: Sequence[str] = (), keep: Sequence[str] = (),
            levels: dict[str, list] | None = None) -> DataFrame:
    """Numeric columns, then one indicator per category but the first.

    Pass the ``levels`` found on the training part to encode another part.
    """
    levels = levels or categories(df, cols)
    flags = [(F.col(c).cast("string") == value).cast("int").alias(f"{c}_{value}")
             for c in cols for value in levels[c][1:]]
    return df.select(*keep, *numeric, *[F.coalesce(f, F.lit(0)).alias(n) for f, n in
                                        zip(flags, [f"{c}_{v}" for c in cols for v in levels[c][1:]])])


def level_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(col, value, level)``: every category with its place among its column's sorted ones, counted from 0.

    Places are ranks over sorted partitions, so there may be any number of
    categories; nothing but their number for each column reaches the driver.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    found = df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()
    ordered = materialise(found.orderBy("col", "value").select("col", "value", F.monotonically_increasing_id().alias("pos")))
    return materialise(with_row_index(ordered, "pos", ["col"], "level").select("col", "value", "level"))


def sparse_one_hot(df: DataFrame, cols: Sequence[str], numeric: Sequence[str] = (), keep: Sequence[str] = (),
                   levels: DataFrame | None = None) -> DataFrame:
    """``(keep..., indices, values)``: the row of :func:`one_hot` without its zeros, for any number of categories.

    Places count the numeric columns first and then each column's categories
    but the first, in the order of ``cols``; a null number, category or a
    category that ``levels`` does not hold has no entry. Pass the ``levels`` of
    the training part to encode another part.
    """
    levels = level_table(df, cols) if levels is None else levels
    sizes = {r["col"]: r["count"] for r in levels.groupBy("col").count().collect()}  # one row for each column
    at, rows, places = len(numeric), df, []
    for i, c in enumerate(cols):
        mine = levels.where(F.col("col") == c).where("level > 0").select(F.col("value").alias(f"__v{i}"), (F.col("level") - 1 + at).alias(f"__i{i}"))
        rows = join_small(rows.withColumn(f"__v{i}", F.col(c).cast("string")), mine, [f"__v{i}"], "left").drop(f"__v{i}")
        places.append(F.struct(F.col(f"__i{i}").cast("bigint").alias("i"), F.lit(1.0).alias("x")))
        at += max(sizes.get(c, 0) - 1, 0)
    given = [F.struct(F.lit(i).cast("bigint").alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(numeric)]
    entries = F.filter(F.array(*given, *places), lambda e: e["i"].isNotNull() & e["x"].isNotNull())
    return rows.select(*keep, entries["i"].alias("indices"), entries["x"].alias("values"))


def aligned_groups(df: DataFrame, features: Sequence[Column | str], target: Column, sensitive: Sequence[Column],
                   keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., x, y, z)``: features, target and sensitive attributes of a row."""
    return df.select(*keep, F.struct(*features).alias("x"), target.alias("y"), F.struct(*sensitive).alias("z"))


def census_features(df: DataFrame) -> DataFrame:
    """Features, target and the two sensitive attributes of the census table.

    Rows of the two largest recorded races only; missing categories become
    their own category.
    """
    kept = df.where(F.col("race").isin("White", "Black")).withColumns({
        "y": F.coalesce(F.col("target") == ">50K", F.lit(False)).cast("int"),
        "z_race": (F.col("race") == "White").cast("int"),
        "z_sex": F.coalesce(F.col("sex") == "Male", F.lit(False)).cast("int")})
    kept = kept.drop("target", "race", "sex", "fnlwgt").fillna("Unknown")
    numeric = ["age", "education_num", "capital_gain", "capital_loss", "hours_per_week"]
    text = ["workclass", "education", "martial_status", "occupation", "relationship", "country"]
    return one_hot(kept, text, numeric, ["y", "z_race", "z_sex"])


def face_features(df: DataFrame) -> DataFrame:
    """``(x, age, gender, race, y)`` of the faces table: pixels and attributes."""
    from tallymark.functions.arrays import pixels

    flags = binarise(age=F.col("age") > 30, race=F.col("ethnicity") == 0)
    out = df.select(pixels("pixels").alias("x"), flags[0], F.col("gender"), flags[1])
    return out.withColumn("y", F.col("age"))
