"""Queries over tabular and array features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog.sql import table
from tallymark.functions import arrays
from tallymark.operators import features


def _long(df, key, col):
    """Array items as rows, so that values compare exactly."""
    return df.select(key, F.posexplode(col).alias("pos", "value")).select(
        key, F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def pixel_arrays(spark, sf_dir):
    """Blank-separated values as scaled channel arrays."""
    texts = _vectors(spark, sf_dir).select(
        "vec_id", F.array_join(F.transform("embedding", lambda x: F.floor(x * 1000).cast("string")), " ").alias("pixels"))
    return _long(texts.select("vec_id", arrays.pixels("pixels").alias("x")), "vec_id", "x")


def normalised_channels(spark, sf_dir):
    """Four channels shifted and scaled by given constants."""
    made = arrays.normalise("embedding", (0.1, 0.2, 0.3, 0.4), (0.5, 0.25, 0.2, 0.3))
    return _long(_vectors(spark, sf_dir).select("vec_id", made.alias("x")), "vec_id", "x")


def random_crops(spark, sf_dir):
    """Repeatable padded crops and mirror images of 8 x 8 images."""
    made = arrays.crop_flip("embedding", "vec_id", 1, 8, 8, padding=4, seed=3)
    return _long(_vectors(spark, sf_dir).select("vec_id", made.alias("x")), "vec_id", "x")


def binarised_attributes(spark, sf_dir):
    """Conditions as 0/1 attributes."""
    flags = features.binarise(rich=F.col("c_acctbal") > 3000, first_nation=F.col("c_nationkey") == 0,
                              household=F.col("c_mktsegment") == "HOUSEHOLD")
    return table(spark, sf_dir, "customer").select("c_custkey", *[f.cast("bigint") for f in flags])


def one_hot_categories(spark, sf_dir):
    """Numeric columns and indicators without the first category."""
    made = features.one_hot(table(spark, sf_dir, "part"), ["p_type"], ["p_size"], ["p_partkey"])
    return made.select(*[F.col(f"`{c}`").cast("bigint").alias(c) for c in made.columns])


def sparse_categories(spark, sf_dir):
    """Numbers and categories, as many as there are parts, as entries of a sparse row."""
    made = features.sparse_one_hot(table(spark, sf_dir, "part"), ["p_type", "p_name"], ["p_size"], ["p_partkey"])
    return made.select("p_partkey", F.explode(F.arrays_zip("indices", "values")).alias("e")).select("p_partkey", "e.indices", "e.values")


def aligned_feature_groups(spark, sf_dir):
    """Features, target and sensitive attributes of each row."""
    made = features.aligned_groups(
        table(spark, sf_dir, "customer"), [F.col("c_acctbal").alias("balance")],
        (F.col("c_acctbal") > 5000).cast("bigint"),
        [(F.col("c_nationkey") < 10).cast("bigint").alias("near"), (F.col("c_mktsegment") == "BUILDING").cast("bigint").alias("building")],
        ["c_custkey"])
    return made.select("c_custkey", "x.balance", "y", "z.near", "z.building")


QUERIES = {f.__name__: f for f in (
    pixel_arrays, normalised_channels, random_crops, binarised_attributes, one_hot_categories, sparse_categories, aligned_feature_groups)}

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

ORACLES = {
    "pixel_arrays": """
SELECT vec_id, c * len(embedding) + i - 1 AS pos, CAST(floor(embedding[i]::DOUBLE * 1000)::FLOAT::DOUBLE / 255 AS FLOAT)::DOUBLE AS value
FROM embeddings, range(3) t(c), generate_series(1, len(embedding)) s(i)""",
    "normalised_channels": """
SELECT vec_id, i - 1 AS pos, (embedding[i]::DOUBLE - ([0.1, 0.2, 0.3, 0.4]::DOUBLE[])[(i - 1) // (len(embedding) // 4) + 1])
       / ([0.5, 0.25, 0.2, 0.3]::DOUBLE[])[(i - 1) // (len(embedding) // 4) + 1] AS value
FROM embeddings, generate_series(1, len(embedding)) s(i)""",
    "random_crops": """
WITH d AS (SELECT vec_id, embedding, draw % 9 AS up, draw // 9 % 9 AS aside, draw // 81 = 1 AS mirrored FROM (
  SELECT *, ('0x' || substr(sha256('3:' || vec_id), 1, 8))::BIGINT % 162 AS draw FROM embeddings)),
p AS (SELECT vec_id, embedding, i, i // 8 + up - 4 AS y, CASE WHEN mirrored THEN 7 - i % 8 ELSE i % 8 END + aside - 4 AS x
  FROM d, range(64) t(i))
SELECT vec_id, i AS pos, CASE WHEN y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 THEN embedding[y * 8 + x + 1]::DOUBLE ELSE 0.0 END::DOUBLE AS value
FROM p""",
    "binarised_attributes": """
SELECT c_custkey, (c_acctbal > 3000)::BIGINT AS rich, (c_nationkey = 0)::BIGINT AS first_nation,
       (c_mktsegment = 'HOUSEHOLD')::BIGINT AS household FROM customer""",
    "one_hot_categories": None,
    "sparse_categories": """
WITH t AS (SELECT DISTINCT p_type AS v FROM part), n AS (SELECT DISTINCT p_name AS v FROM part),
tl AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS level FROM t), nl AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS level FROM n),
e AS (SELECT p_partkey, 0 AS indices, p_size::DOUBLE AS values FROM part
      UNION ALL SELECT p_partkey, level, 1.0 FROM part JOIN tl ON v = p_type WHERE level > 0
      UNION ALL SELECT p_partkey, level + (SELECT count(*) - 1 FROM t), 1.0 FROM part JOIN nl ON v = p_name WHERE level > 0)
SELECT p_partkey, indices::BIGINT AS indices, values::DOUBLE AS values FROM e""",
    "one_hot_categories": "SELECT p_partkey, p_size::BIGINT AS p_size, " + ", ".join(
        f"(p_type = '{t}')::BIGINT AS p_type_{t}" for t in TYPES[1:]) + " FROM part",
    "aligned_feature_groups": """
SELECT c_custkey, c_acctbal AS balance, (c_acctbal > 5000)::BIGINT AS y, (c_nationkey < 10)::BIGINT AS near,
       (c_mktsegment = 'BUILDING')::BIGINT AS building FROM customer""",
}
