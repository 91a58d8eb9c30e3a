"""Evidence tables: assembling, binding and verifying digests.

Evidence is a long table ``(proof, section, name, algo, n_rows, digest_b64)``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.hashing import JSON_OPTIONS, bytes_to_base64, canonical_json, hex_to_base64, one_line_base64
from tallymark.operators.chain import chain_digest
from tallymark.operators.curve import ec_multiset_digest
from tallymark.operators.multiset import STATE, element_state, merge_states, multiset_digest, multiset_state, state_hex
from tallymark.session import join_null_safe

COLUMNS = ["proof", "section", "name", "algo", "n_rows", "digest_b64"]


def evidence_rows(df: DataFrame, proof: str, section: str, name: Column | str, digest: Column,
                  algo: str, n_rows: Column | None = None) -> DataFrame:
    """Rows of the evidence table from a table of digests."""
    return df.select(F.lit(proof).alias("proof"), F.lit(section).alias("section"),
                     (F.lit(name) if isinstance(name, str) else name).alias("name"), F.lit(algo).alias("algo"),
                     (F.lit(None) if n_rows is None else n_rows).cast("bigint").alias("n_rows"),
                     digest.alias("digest_b64"))


def file_evidence(manifest: DataFrame, proof: str, section: str) -> DataFrame:
    """One row per file of a manifest, named ``split/file``."""
    return evidence_rows(manifest, proof, section, F.concat_ws("/", "split", "file"),
                         bytes_to_base64(F.col("sha256")), "sha256")


def rows_evidence(df: DataFrame, proof: str, section: str, cols: Sequence[str], idx: str | None,
                  name: str = "train", by: str | None = None, algo: str = "multiset") -> DataFrame:
    """The multiset digest of the rows read, per group if asked for.

    ``multiset`` is the modular group element, ``curve`` the curve point;
    ``sum`` is the exact exponent, which is enough to compare two reads and
    never leaves the JVM.
    """
    groups = [by] if by else []
    if algo == "sum":
        states = multiset_state(df, cols, idx, groups).withColumn("digest_b64", hex_to_base64(state_hex()))
    elif algo == "multiset":
        states = multiset_digest(multiset_state(df, cols, idx, groups))
    elif algo == "curve":
        states = ec_multiset_digest(df, cols, idx, groups)
    else:
        raise ValueError(f"unknown digest {algo!r}")
    return evidence_rows(states, proof, section, F.col(by) if by else name, F.col("digest_b64"), algo, F.col("n"))


def object_digest(cols: Sequence[str | Column]) -> Column:
    """SHA-256 of a row's canonical JSON."""
    return F.sha2(canonical_json(list(cols)), 256)


def table_evidence(df: DataFrame, proof: str, section: str, name: str, cols: Sequence[str], idx: str) -> DataFrame:
    """The order-sensitive digest of an ordered result table."""
    made = chain_digest(df, cols, idx)
    return evidence_rows(made, proof, section, name, bytes_to_base64(F.when(F.length("chain") == 64, F.col("chain"))
                                                                    .otherwise(F.sha2("chain", 256))), "chain", F.col("n"))


def union_evidence(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0].select(*COLUMNS)
    for part in parts[1:]:
        whole = whole.unionByName(part.select(*COLUMNS))
    return whole


def payload(evidence: DataFrame) -> DataFrame:
    """``(proof, payload)``: nested JSON ``{section: {name: digest}}``, all keys sorted."""
    entry = F.struct("name", "digest_b64")
    sections = evidence.groupBy("proof", "section").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("entries"))
    nested = F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("section", F.to_json("entries", JSON_OPTIONS).alias("json")))),
        lambda s: F.struct(s["section"], s["json"])))
    pieces = F.transform(F.map_entries(nested), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    text = F.concat(F.lit("{"), F.array_join(pieces, ","), F.lit("}"))
    return sections.groupBy("proof").agg(text.alias("payload"))


def seal(payloads: DataFrame, nonce: bytes = b"") -> DataFrame:
    """Add the payload in base64 and SHA-512 over payload and challenge, 64 bytes."""
    signed = F.concat(F.encode("payload", "UTF-8"), F.lit(bytearray(nonce)))
    return payloads.withColumn("payload_b64", one_line_base64(F.encode("payload", "UTF-8"))).withColumn(
        "report_data", F.sha2(signed, 512))


def verify(claimed: DataFrame, recomputed: DataFrame) -> DataFrame:
    """``(proof, section, name, status)``: match, mismatch, missing or extra.

    ``missing`` was recomputed but not claimed, ``extra`` claimed only.
    """
    keys = ["proof", "section", "name"]
    a = claimed.select(*keys, F.col("digest_b64").alias("__c"), F.lit(1).alias("__ic"))
    b = recomputed.select(*keys, F.col("digest_b64").alias("__r"), F.lit(1).alias("__ir"))
    status = (F.when(F.col("__ic").isNull(), "missing").when(F.col("__ir").isNull(), "extra")
              .when(F.col("__c") == F.col("__r"), "match").otherwise("mismatch"))
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def accepted(statuses: DataFrame) -> DataFrame:
    """One row: whether every digest matches."""
    return statuses.agg((F.count(F.when(F.col("status") != "match", 1)) == 0).alias("accepted"),
                        F.count(F.lit(1)).alias("digests"))


def verify_seal(sealed: DataFrame, nonce: bytes) -> DataFrame:
    """Add ``fresh``: the stored digest is that of payload and this challenge."""
    again = F.sha2(F.concat(F.unbase64("payload_b64"), F.lit(bytearray(nonce))), 512)
    return sealed.withColumn("fresh", again == F.col("report_data"))


def judge_seals(offers: DataFrame, issued: DataFrame, used: DataFrame, lifetime: Column, bits: int = 512) -> DataFrame:
    """Accept the seal of each issued challenge once: ``offers`` with ``status``.

    ``offers`` has ``offer, nonce, payload, report_data, received``, ``issued``
    the register of challenges (``nonce, issued``; the earliest row counts),
    ``used`` the challenges answered before (``nonce``). A seal is ``unknown``
    without a challenge, ``forged`` unless it is the digest of its payload and
    challenge, ``expired`` if received before the issue or after ``lifetime``
    from it, ``replayed`` if the challenge was used or an earlier valid offer
    (then the smaller ``offer``) answers it, else ``fresh``. Rows of one
    ``offer`` and time are one offer. The fresh rows' nonces belong into the
    register of used ones.
    """
    known = issued.select("nonce", "issued", F.lit(False).alias("used")).unionByName(
        used.select("nonce", F.lit(None).cast(issued.schema["issued"].dataType).alias("issued"), F.lit(True).alias("used")))
    register = known.groupBy("nonce").agg(F.min("issued").alias("__issued"), F.max("used").alias("__used"))
    digest = F.sha2(F.concat(F.encode("payload", "UTF-8"), F.encode("nonce", "UTF-8")), bits)
    genuine = F.coalesce(digest == F.col("report_data"), F.lit(False))
    in_time = F.coalesce((F.col("received") >= F.col("__issued")) & (F.col("received") <= F.col("__issued") + lifetime), F.lit(False))
    # a minimum per challenge and not a ranking, so that a challenge with very many replays is never sorted; only
    # genuine seals travel for it, without what they sign
    valid = offers.where(genuine).select("nonce", "received", "offer").join(register.where(~F.col("__used")), "nonce").where(in_time)
    first = valid.groupBy("nonce").agg(F.min(F.struct("received", "offer")).alias("__first"))
    told = offers.withColumn("__genuine", genuine).join(register, "nonce", "left").join(first, "nonce", "left")
    status = (F.when(F.col("__issued").isNull(), "unknown").when(~F.col("__genuine"), "forged").when(~in_time, "expired")
              .when(F.col("__used"), "replayed").when(F.struct("received", "offer") == F.col("__first"), "fresh").otherwise("replayed"))
    return told.select(*[F.col(f"`{c}`") for c in offers.columns], status.alias("status"))


def bind(manifest: DataFrame, stored: DataFrame, reads: DataFrame, cols: Sequence[str], idx: str,
         readings: dict[str, Column] | None = None) -> DataFrame:
    """Per split: file digests beside the digest of the rows read.

    ``bound`` tells whether exactly the stored rows were read, each once:
    counts agree and so do the multiset states. A split without files, or
    with files but without rows, is not bound.

    ``readings`` binds several readings of the stored rows at once, as rows of
    a first column ``reading``: for each name, how often that reading holds a
    row of ``reads`` (null: not at all). Every row is read and hashed once,
    however many readings hold it, since states add up.
    """
    names, one = list(readings or {"": None}), F.lit(1).cast("bigint")
    times = [F.coalesce(c.cast("bigint"), one - 1) for c in readings.values()] if readings else [one]
    # how often the stored side and each reading hold a row
    held = [f"__t{i}" for i in range(len(names) + 1)]
    sides = [t.select("split", *cols, idx, *[c.alias(h) for c, h in zip(weights, held)])
             for t, weights in ((stored, [one] + [one - 1] * len(names)), (reads, [one - 1] + times))]
    alike = multiset_state(sides[0].unionByName(sides[1]), cols, idx, ["split", *held])
    each = alike.select("split", F.posexplode(F.array(*held)).alias("__of", "__times"), *STATE)
    states = merge_states(each.select("split", "__of", *[(F.col(c) * F.col("__times")).alias(c) for c in STATE]), ["split", "__of"])

    def of(side: int, c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("__of") == side, F.col(c))), F.lit(0))

    def compared(i: int, name: str) -> Column:
        same = F.lit(True)
        for c in STATE:
            same = same & (of(0, c) == of(i, c))
        return F.struct(F.lit(name).alias("reading"), of(0, "n").alias("n_rows"), same.alias("bound"), *[of(i, c).alias(c) for c in STATE])

    wide = states.groupBy("split").agg(F.array(*[compared(i, name) for i, name in enumerate(names, 1)]).alias("__r")).select("split", F.inline("__r"))
    files = element_state(manifest, F.concat_ws("#", "file", "sha256"), ["split"]).select(
        F.col("split").alias("__split"), F.explode(F.array(*[F.lit(n) for n in names])).alias("__reading"), F.col("n").alias("n_files"),
        hex_to_base64(state_hex()).alias("files_digest"))
    none = F.lit(0).cast("bigint")
    both = join_null_safe(files, multiset_digest(wide).withColumns({"__split": F.col("split"), "__reading": F.col("reading")}),
                          ["__split", "__reading"], "full_outer")
    first = [F.coalesce("reading", "__reading").alias("reading")] if readings else []
    return both.select(
        *first, F.coalesce("split", "__split").alias("split"), F.coalesce("n_files", none).alias("n_files"), "files_digest",
        F.coalesce("n_rows", none).alias("n_rows"), F.coalesce("n", none).alias("n_accesses"), "digest_b64",
        (F.coalesce("bound", F.lit(False)) & F.col("n_files").isNotNull()).alias("bound"))


def config_digest(settings: DataFrame, by: Sequence[str] = (), key: str = "key", value: str = "value") -> DataFrame:
    """``(by..., config, sha256)``: settings as JSON with sorted keys."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    made = settings.groupBy(*by).agg(F.to_json(pairs, JSON_OPTIONS).alias("config"))
    return made.withColumn("sha256", F.sha2("config", 256))


def config_settings(value, name: str = "") -> list[tuple[str, str]]:
    """A nested setting tree as ``(key, JSON value)`` pairs in canonical form.

    Sets become sorted lists; items of lists and maps become text, and so does
    whatever JSON has no form for.
    """
    import json

    def plain(v):
        if isinstance(v, (set, frozenset)):
            return [str(x) for x in sorted(v, key=str)]
        if isinstance(v, dict):
            return {str(k): str(v[k]) for k in sorted(v, key=str)}
        if isinstance(v, (list, tuple)):
            return [str(x) for x in v]
        return v if v is None or isinstance(v, (str, int, float, bool)) else str(v)

    return [(str(k), json.dumps(plain(value[k]))) for k in sorted(value, key=str)]


def artifact_manifest(digests: DataFrame, root: str) -> DataFrame:
    """``(file, bytes, sha256)`` of a folder tree, named relative to its root.

    A file outside the root is an error.
    """
    plain = F.regexp_replace("path", "^file:/+", "/")
    start = re.sub("^file:/+", "/", root.rstrip("/")) + "/"
    outside = F.raise_error(F.concat(F.lit(f"not below {start}: "), plain)).cast("string")
    relative = F.when(F.startswith(plain, F.lit(start)), F.substring(plain, F.lit(len(start) + 1), F.length(plain))).otherwise(outside)
    return digests.select(relative.alias("file"), "bytes", "sha256")
