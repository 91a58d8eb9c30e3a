"""Multiset digests: laws of the group, and the sequential definition."""

import hashlib
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.operators import multiset as m
from tallymark.operators.curve import B, P, ec_merge, ec_multiset_digest, ec_partials


def product(elements):
    value = 1
    for e in elements:
        value = value * pow(2, int(hashlib.sha256(e.encode()).hexdigest(), 16), m.MODULUS) % m.MODULUS
    return format(value, "x")


def probably_prime(n):
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7, 11, 13):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def test_modulus_is_the_next_prime():
    small = [p for p in range(3, 2000) if all(p % q for q in range(2, int(p**0.5) + 1))]
    assert probably_prime(m.MODULUS)
    for n in range((1 << 2048) + 1, m.MODULUS, 2):
        assert any(n % p == 0 for p in small) or pow(3, n - 1, n) != 1


def elements(spark, values, parts):
    return spark.createDataFrame([(v,) for v in values], "e string").repartition(parts)


def test_equals_sequential_product_in_any_order(spark):
    values = [str(i) for i in range(100)]
    want = product(values)
    for seed, parts in ((1, 1), (2, 7)):
        random.Random(seed).shuffle(values)
        got = m.multiset_digest(m.element_state(elements(spark, values, parts), F.col("e"))).first()
        assert (got.n, got.digest_hex) == (100, want)
    changed = m.multiset_digest(m.element_state(elements(spark, values[1:] + ["x"], 3), F.col("e"))).first()
    assert changed.digest_hex != want


def test_empty_set_is_one(spark, docs):
    got = m.multiset_digest(m.multiset_state(docs.where("false"), ["text"], "doc_id")).first()
    assert (got.n, got.hi, got.l7, got.digest_hex, got.digest_b64) == (0, 0, 0, "1", "AQ==")


def test_python_form_matches_json_dumps_and_position(spark, docs):
    rows = docs.select("text", "lang", "doc_id").collect()
    want = product([json.dumps({"text": r.text, "lang": r.lang}) + str(r.doc_id) for r in rows])
    got = m.multiset_digest(m.multiset_state(docs, ["text", "lang"], "doc_id", form="python")).first()
    assert got.digest_hex == want


def test_nulls_stay_apart(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "x", None)], "i int, a string, b string")
    states = m.multiset_state(df, ["a", "b"], by=["i"]).drop("i").distinct()
    assert states.count() == 2


def test_remove_and_merge(spark, docs):
    whole = m.multiset_state(docs, ["text"], "doc_id").first()
    parts = m.multiset_state(docs, ["text"], "doc_id", by=["lang"])
    assert m.merge_states(parts).first() == whole
    signed = docs.select("text", "doc_id", F.lit(1).alias("s")).unionByName(docs.select("text", "doc_id", F.lit(-1).alias("s")))
    gone = m.multiset_state(signed, ["text"], "doc_id", sign=F.col("s")).first()
    assert all(v == 0 for v in gone)
    negative = m.multiset_state(docs, ["text"], "doc_id", sign=F.lit(-1))
    both = m.merge_states(negative.unionByName(m.multiset_state(docs, ["text"], "doc_id"))).first()
    assert all(v == 0 for v in both)
    inverse = m.multiset_digest(negative).first().digest_hex
    direct = m.multiset_digest(m.multiset_state(docs, ["text"], "doc_id")).first().digest_hex
    assert int(inverse, 16) * int(direct, 16) % m.MODULUS == 1


def test_equality(spark, docs):
    assert m.multiset_equal(docs, docs.repartition(3), ["doc_id", "text"]).first().equal
    assert not m.multiset_equal(docs, docs.unionByName(docs.limit(1)), ["doc_id", "text"]).first().equal
    twice = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")
    other = spark.createDataFrame([("a",), ("b",), ("b",)], "t string")
    assert not m.multiset_equal(twice, other, ["t"]).first().equal


def test_accesses(spark, docs):
    once = m.measured_accesses(docs, ["text"], "doc_id")
    again = docs.unionByName(docs)
    assert m.measured_accesses(docs, ["text"], "doc_id", epochs=2).first() == m.multiset_state(again, ["text"], "doc_id").first()
    off = m.measured_accesses(docs, ["text"], "doc_id", measure=False).first()
    assert off.n == once.first().n and all(off[c] == 0 for c in m.STATE[1:])
    log = spark.createDataFrame([(1, 1, 1.0, 0.5), (1, 3, 3.0, 1.5), (2, 2, 5.0, 0.5)],
                                "worker int, accesses bigint, load_s double, measure_s double")
    assert tuple(m.access_totals(log).first()) == (2, 5, 4.0, 1.0)


def test_access_totals_carry_the_digest(spark, docs):
    final = m.multiset_state(docs.withColumn("worker", F.col("doc_id") % 3), ["text"], "doc_id", by=["worker"])
    early = final.withColumns({"n": F.lit(0).cast("bigint"), "l7": F.lit(7).cast("bigint")})
    log = early.unionByName(final).withColumnRenamed("n", "accesses").withColumns({"load_s": F.lit(0.0), "measure_s": F.lit(0.0)})
    got = m.access_totals(log).select(*m.STATE).first()
    assert got == m.multiset_state(docs, ["text"], "doc_id").first()


def test_no_python_in_the_aggregation(spark, docs):
    plan = m.multiset_state(docs, ["text"], "doc_id", by=["lang"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Python" not in plan and "SortAggregate" not in plan


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=5), min_size=1, max_size=8), st.integers(1, 5))
def test_property_product(spark, values, parts):
    got = m.multiset_digest(m.element_state(elements(spark, values, parts), F.col("e"))).first()
    assert got.digest_hex == product(values)


# --- curve ---------------------------------------------------------------

def affine_add(p, q):
    if p is None or q is None:
        return p or q
    if p[0] == q[0]:
        if (p[1] + q[1]) % P == 0:
            return None
        slope = (3 * p[0] * p[0] - 3) * pow(2 * p[1], -1, P)
    else:
        slope = (q[1] - p[1]) * pow(q[0] - p[0], -1, P)
    x = (slope * slope - p[0] - q[0]) % P
    return x, (slope * (p[0] - x) - p[1]) % P


def affine_point(data):
    for counter in range(1000):
        x = int.from_bytes(hashlib.sha256(data + counter.to_bytes(4, "big")).digest(), "big") % P
        square = (x**3 - 3 * x + B) % P
        if pow(square, (P - 1) // 2, P) == 1:
            return x, pow(square, (P + 1) // 4, P)


def affine_digest(values):
    total = None
    for v in values:
        total = affine_add(total, affine_point(v.encode()))
    return 0 if total is None else int.from_bytes(bytes([2 + total[1] % 2]) + total[0].to_bytes(32, "big"), "big")


@pytest.mark.parametrize("parts", [1, 5])
def test_curve_equals_plain_arithmetic(spark, parts):
    values = [str(i) for i in range(40)] + ["3", "3"]
    df = elements(spark, values, parts)
    got = ec_merge(ec_partials(df, F.col("e"))).first()
    assert (got.n, int(got.digest_hex, 16)) == (42, affine_digest(values))


def test_curve_groups_removal_and_empty(spark, docs):
    empty = ec_multiset_digest(docs.where("false"), ["text"]).first()
    assert (empty.n, empty.digest_hex) == (0, "0")
    both = docs.select("text", "lang", F.lit(1).alias("s")).unionByName(docs.select("text", "lang", F.lit(-1).alias("s")))
    gone = ec_multiset_digest(both, ["text"], sign=F.col("s")).first()
    assert (gone.n, gone.digest_hex) == (0, "0")
    grouped = {r.lang: r for r in ec_multiset_digest(docs, ["text"], "doc_id", by=["lang"]).collect()}
    for lang, row in grouped.items():
        alone = ec_multiset_digest(docs.where(F.col("lang") == lang), ["text"], "doc_id").first()
        assert (row.n, row.digest_hex) == (alone.n, alone.digest_hex)


def test_a_reordered_copy_has_no_fixed_number_of_pieces(spark):
    from tallymark.catalog import all_queries

    made = all_queries()["multiset_equality"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions [source" in plan and "Repartition" not in plan.replace("RepartitionByExpression [doc_id", "")
    assert sorted((r.kind, r.equal) for r in made.collect()) == [("changed", False), ("moved", True)]
