"""Order-independent multiset digest of the rows of a table.

A row's element hash is an exponent: the digest of a multiset is
``2**(sum of sha256) mod p``. The sum is an ordinary aggregation. Sixteen
16-bit digit sums cannot overflow below 2**47 rows per group; the state kept is
the total in base 2**32: ``n, hi, l0..l7`` with ``l0`` the top limb and ``hi``
what lies above 256 bits. Equal totals have equal states, states add up, and
only the last step, one row per group, leaves the JVM.

The exponents are known, so finding two multisets with one digest is a
subset-sum problem, much easier than the modulus size suggests. Use
:mod:`tallymark.operators.curve` against an adversary.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.hashing import LIMBS, carry_chain, hash_words, hex_to_base64, row_element, word_halves

# Fixed value: the least prime above 2**2048.
MODULUS = (1 << 2048) + 981

STATE = ["n", "hi", *LIMBS]


def element_state(df: DataFrame, element: Column, by: Sequence[str] = (), sign: Column | None = None) -> DataFrame:
    """State per group of any text elements; ``sign`` -1 removes an element."""
    by = list(by)
    factor = (F.lit(1) if sign is None else sign).cast("bigint").alias("__sign")
    hashed = df.select(*by, factor, F.sha2(element, 256).alias("__h"))
    words = hashed.select(*by, "__sign", *[w.alias(f"__w{i}") for i, w in enumerate(hash_words(F.col("__h")))])
    digits = word_halves([F.col(f"__w{i}") for i in range(6)])
    signed = digits if sign is None else [d * F.col("__sign") for d in digits]
    sums = [F.coalesce(F.sum(d), F.lit(0)).alias(f"__s{i}") for i, d in enumerate(signed)]
    n = (F.count(F.lit(1)) if sign is None else F.coalesce(F.sum("__sign"), F.lit(0))).alias("n")
    grouped = words.groupBy(*by).agg(n, *sums)
    hi, digits = carry_chain([F.col(f"__s{i}") for i in range(16)], 16)
    limbs = [(digits[2 * i] * 65536 + digits[2 * i + 1]).alias(LIMBS[i]) for i in range(8)]
    return grouped.select(*by, "n", hi.alias("hi"), *limbs)


def multiset_state(df: DataFrame, cols: Sequence[str], idx: str | None = None, by: Sequence[str] = (),
                   sign: Column | None = None, form: str = "canonical") -> DataFrame:
    """State per group of the rows' encodings, with their positions if given."""
    return element_state(df, row_element(cols, idx, form), by, sign)


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add up states kept per day, partition, worker or batch."""
    by = list(by)
    total = states.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATE])
    hi, limbs = carry_chain([F.col(c) for c in LIMBS], 32)
    return total.select(*by, "n", (F.col("hi") + hi).alias("hi"), *[v.alias(c) for v, c in zip(limbs, LIMBS)])


def _fold():
    @F.pandas_udf(T.StringType())
    def fold(hi: pd.Series, l0: pd.Series, l1: pd.Series, l2: pd.Series, l3: pd.Series,
             l4: pd.Series, l5: pd.Series, l6: pd.Series, l7: pd.Series) -> pd.Series:
        out = []
        for row in zip(hi, l0, l1, l2, l3, l4, l5, l6, l7):
            total = 0
            for limb in row:
                total = (total << 32) + int(limb)
            out.append(format(pow(2, total % (MODULUS - 1), MODULUS), "x"))
        return pd.Series(out)

    return fold


def multiset_digest(states: DataFrame) -> DataFrame:
    """Add the group element as ``digest_hex`` and ``digest_b64``; one row per group."""
    out = states.withColumn("digest_hex", _fold()("hi", *LIMBS))
    return out.withColumn("digest_b64", hex_to_base64(F.col("digest_hex")))


def state_hex(hi: str = "hi") -> Column:
    """The exact total of a state as hex text: ``hi`` and eight 32-bit limbs."""
    limbs = [F.lpad(F.lower(F.hex(F.col(c))), 8, "0") for c in LIMBS]
    return F.concat(F.lower(F.hex(F.col(hi))), *limbs)


def multiset_equal(left: DataFrame, right: DataFrame, cols: Sequence[str], idx: str | None = None) -> DataFrame:
    """One row telling whether two tables hold the same rows as multisets."""
    keep = list(cols) + ([idx] if idx and idx not in cols else [])
    both = left.select(*keep, F.lit(1).alias("__side")).unionByName(right.select(*keep, F.lit(-1).alias("__side")))
    state = multiset_state(both, cols, idx, sign=F.col("__side"))
    zero = F.lit(True)
    for c in STATE:
        zero = zero & (F.col(c) == 0)
    return state.select(zero.alias("equal"))


def access_totals(states: DataFrame, worker: str = "worker") -> DataFrame:
    """Totals over workers from a log of running states.

    Each worker's last state is the one with the most accesses; counts add up,
    times are averaged over workers. Carries the digest state if it is there.
    """
    carried = [c for c in STATE if c in states.columns and c != "n"]
    values = ["load_s", "measure_s", *carried]
    last = states.groupBy(worker).agg(F.max("accesses").alias("accesses"),
                                      *[F.max_by(c, "accesses").alias(c) for c in values])
    total = last.agg(F.count(F.lit(1)).alias("workers"), F.sum("accesses").alias("n"),
                     (F.sum("load_s") / F.count(F.lit(1))).alias("load_s"),
                     (F.sum("measure_s") / F.count(F.lit(1))).alias("measure_s"),
                     *[F.sum(c).alias(c) for c in carried])
    if not carried:
        return total
    hi, limbs = carry_chain([F.col(c) for c in LIMBS], 32)
    return total.select("workers", "n", "load_s", "measure_s", (F.col("hi") + hi).alias("hi"),
                        *[v.alias(c) for v, c in zip(limbs, LIMBS)])


def measured_accesses(df: DataFrame, cols: Sequence[str], idx: str, measure: bool = True, epochs: int = 1,
                      mode: str = "row") -> DataFrame:
    """What a reader of every row reports: access count and digest state.

    ``epochs`` counts repeated reads. Whole-file mode, or measuring switched
    off, counts accesses but leaves the digest at its identity.
    """
    if measure and mode == "row":
        state = multiset_state(df, cols, idx)
    else:
        zeros = [F.lit(0).cast("bigint").alias(c) for c in STATE[1:]]
        state = df.agg(F.count(F.lit(1)).alias("n")).select("n", *zeros)
    hi, limbs = carry_chain([F.col(c) * epochs for c in LIMBS], 32)
    return state.select((F.col("n") * epochs).alias("n"), (F.col("hi") * epochs + hi).alias("hi"),
                        *[v.alias(c) for v, c in zip(limbs, LIMBS)])


def partition_accesses(df: DataFrame, cols: Sequence[str], idx: str) -> DataFrame:
    """One state per task that read rows: the counterpart of per-worker state."""
    tagged = df.withColumn("worker", F.spark_partition_id())
    return multiset_state(tagged, cols, idx, by=["worker"])
