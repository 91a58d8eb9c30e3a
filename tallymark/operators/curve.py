"""Multiset digest on the P-256 curve.

An element is hashed to a curve point by try-and-increment and points add up.
Big-integer curve arithmetic has no Spark expression, so each task folds its
rows to one point per group and the partial points are then added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.hashing import hex_to_base64, row_element

# The NIST P-256 curve, y^2 = x^3 - 3x + B over the field of P elements.
P = 2**256 - 2**224 + 2**192 + 2**96 - 1
B = 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B

MERGE_SETS = 256


def _root(x: int) -> int | None:
    """A square root of ``x^3 - 3x + B`` if there is one."""
    square = (x * x * x - 3 * x + B) % P
    y = pow(square, (P + 1) // 4, P)
    return y if y * y % P == square else None


def hash_to_point(data: bytes) -> tuple[int, int]:
    """First curve point with ``x = sha256(data + counter)``, counter from 0."""
    counter = 0
    while True:
        x = int.from_bytes(hashlib.sha256(data + counter.to_bytes(4, "big")).digest(), "big") % P
        y = _root(x)
        if y is not None:
            return x, y
        counter += 1


def _double(p):
    x, y, z = p
    if not z or not y:
        return 0, 1, 0
    delta, gamma = z * z % P, y * y % P
    beta = x * gamma % P
    alpha = 3 * (x - delta) * (x + delta) % P
    x3 = (alpha * alpha - 8 * beta) % P
    return x3, (alpha * (4 * beta - x3) - 8 * gamma * gamma) % P, 2 * y * z % P


def add_points(p, q):
    """Sum of two points in Jacobian coordinates; ``z = 0`` is the identity."""
    if not p[2]:
        return q
    if not q[2]:
        return p
    z1, z2 = p[2] * p[2] % P, q[2] * q[2] % P
    u1, u2 = p[0] * z2 % P, q[0] * z1 % P
    s1, s2 = p[1] * z2 * q[2] % P, q[1] * z1 * p[2] % P
    if u1 == u2:
        return _double(p) if s1 == s2 else (0, 1, 0)
    h, r = (u2 - u1) % P, (s2 - s1) % P
    hh = h * h % P
    hhh, v = h * hh % P, u1 * hh % P
    x3 = (r * r - hhh - 2 * v) % P
    return x3, (r * (v - x3) - s1 * hhh) % P, p[2] * q[2] * h % P


def compress(p) -> int:
    """Compressed point as an integer; the identity is 0."""
    if not p[2]:
        return 0
    inverse = pow(p[2], -1, P)
    square = inverse * inverse % P
    x, y = p[0] * square % P, p[1] * square * inverse % P
    return ((2 + (y & 1)) << 256) | x


def decompress(digest: int):
    """Point of a compressed digest."""
    if not digest:
        return 0, 1, 0
    x, odd = digest & ((1 << 256) - 1), (digest >> 256) & 1
    y = _root(x)
    if y is None:
        raise ValueError("not a point of the curve")
    return x, (y if y & 1 == odd else P - y), 1


def ec_partials(df: DataFrame, element: Column, by: Sequence[str] = (), sign: Column | None = None) -> DataFrame:
    """``(by..., n, point)``: one compressed point per group and task."""
    by = list(by)
    factor = F.lit(1) if sign is None else sign
    rows = df.select(*by, factor.cast("bigint").alias("sign"), element.alias("element"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields]
                       + ["n bigint", "point string"])

    def fold(batches):
        states = {}
        for batch in batches:
            keys = zip(*[batch[c] for c in by]) if by else [()] * len(batch)
            for key, step, text in zip(keys, batch["sign"], batch["element"]):
                x, y = hash_to_point(text.encode())
                for _ in range(abs(step)):
                    n, total = states.get(key, (0, (0, 1, 0)))
                    states[key] = (n + (1 if step > 0 else -1), add_points(total, (x, y if step > 0 else P - y, 1)))
        rows = [(*key, n, format(compress(total), "x")) for key, (n, total) in states.items()]
        if rows:
            yield pd.DataFrame(rows, columns=[*by, "n", "point"])

    return rows.mapInPandas(fold, schema)


def ec_merge(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add stored points per group: ``(by..., n, digest_hex, digest_b64)``.

    Partials are added in bounded sets first, so a group seen by every task is
    not added up by one task alone.
    """
    by = list(by)
    if not by:
        identity = partials.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n"), F.lit("0").alias("point"))
        partials = partials.select("n", "point").unionByName(identity)

    @F.pandas_udf(T.StringType())
    def add_up(points: pd.Series) -> str:
        total = (0, 1, 0)
        for point in points:
            total = add_points(total, decompress(int(point, 16)))
        return format(compress(total), "x")

    @F.pandas_udf(T.LongType())
    def count_up(counts: pd.Series) -> int:
        return int(counts.sum())

    sums = [count_up("n").alias("n"), add_up("point").alias("point")]
    spread = partials.withColumn("__set", F.pmod(F.hash("point"), F.lit(MERGE_SETS)))
    merged = spread.groupBy(*by, "__set").agg(*sums).groupBy(*by).agg(*sums)
    return merged.select(*by, "n", F.col("point").alias("digest_hex"), hex_to_base64(F.col("point")).alias("digest_b64"))


def ec_multiset_digest(df: DataFrame, cols: Sequence[str], idx: str | None = None, by: Sequence[str] = (),
                       sign: Column | None = None, form: str = "canonical") -> DataFrame:
    """Curve digest of the rows per group."""
    return ec_merge(ec_partials(df, row_element(cols, idx, form), by, sign), by)
