"""Queries over digests and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog.sql import STATE_HEX, chain, element, encoded, literal, state, table, trimmed_base64, vocabulary
from tallymark.catalog.sql import chains as chains_sql
from tallymark.functions.hashing import bytes_to_base64, hex_to_base64, row_element
from tallymark.operators import chain as chains
from tallymark.operators import curve, evidence, multiset, ordering, words
from tallymark.session import fresh_path, materialise
from tallymark.sources import files, shards
from tallymark.streaming import multiset as streams

DOC = ["doc_id", "text", "lang", "source", "n_chars"]


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def object_digest(spark, sf_dir):
    """Digest of every row as an object."""
    return _docs(spark, sf_dir).select("doc_id", evidence.object_digest(DOC).alias("sha256"))


def row_encoding(spark, sf_dir):
    """The text that is hashed for every row and position."""
    return _docs(spark, sf_dir).select("doc_id", row_element(DOC, "doc_id").alias("element"))


def python_row_encoding(spark, sf_dir):
    """The same in the compatibility form."""
    return _docs(spark, sf_dir).select("doc_id", row_element(["text"], "doc_id", "python").alias("element"))


def multiset_state(spark, sf_dir):
    """State of all documents."""
    return multiset.multiset_state(_docs(spark, sf_dir), DOC, "doc_id")


def multiset_digest(spark, sf_dir):
    """Group element of all line items, by return flag."""
    lines = table(spark, sf_dir, "lineitem")
    states = multiset.multiset_state(lines, lines.columns, by=["l_returnflag"])
    return multiset.multiset_digest(states).select("l_returnflag", "n", "digest_hex", "digest_b64")


def multiset_of_orders(spark, sf_dir):
    """State of a wide table without positions, by status."""
    orders = table(spark, sf_dir, "orders").withColumns({
        "o_totalprice": F.col("o_totalprice").cast("decimal(18,4)").cast("string"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")})
    return multiset.multiset_state(orders, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"], by=["o_orderstatus"])


def multiset_remove(spark, sf_dir):
    """All documents added, the English ones removed again."""
    docs = _docs(spark, sf_dir).select(*DOC, F.lit(1).alias("sign"))
    gone = docs.where("lang = 'en'").withColumn("sign", F.lit(-1))
    return multiset.multiset_state(docs.unionByName(gone), DOC, "doc_id", sign=F.col("sign"))


def multiset_merge(spark, sf_dir):
    """Stored states per source, merged per language."""
    stored = multiset.multiset_state(_docs(spark, sf_dir), DOC, "doc_id", by=["lang", "source"])
    return multiset.merge_states(stored, ["lang"])


def multiset_equality(spark, sf_dir):
    """A reordered copy is equal, one with a changed row is not."""
    docs = _docs(spark, sf_dir)
    moved = docs.hint("rebalance", "source")  # by source, and a large source in as many pieces as its size takes
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 5, "x").otherwise(F.col("text")))
    same = multiset.multiset_equal(docs, moved, DOC).select(F.lit("moved").alias("kind"), "equal")
    return same.unionByName(multiset.multiset_equal(docs, changed, DOC).select(F.lit("changed").alias("kind"), "equal"))


def digest_per_task_and_split(spark, sf_dir):
    """State per task and split in one pass."""
    rows = _docs(spark, sf_dir).select(*DOC, F.concat_ws(":", "source", "lang").alias("key"))
    return multiset.multiset_state(rows, DOC, "doc_id", by=["key"])


def curve_digest(spark, sf_dir):
    """Curve digest of the documents per language."""
    return curve.ec_multiset_digest(_docs(spark, sf_dir), DOC, "doc_id", by=["lang"])


def chain_blocks(spark, sf_dir):
    """Chain over every block of 64 rows."""
    return chains.chain_blocks(_docs(spark, sf_dir), evidence.object_digest(DOC), "doc_id", 64)


def chain_root(spark, sf_dir):
    """Order-sensitive digest of all documents."""
    docs = ordering.with_row_index(_docs(spark, sf_dir), "doc_id")
    return chains.chain_digest(docs, DOC, "row_idx", block=64)


def _keyed(spark, sf_dir):
    """Documents with source and language as key and their position there."""
    docs = _docs(spark, sf_dir).select(*DOC, F.concat_ws(":", "source", "lang").alias("key"))
    return ordering.with_row_index(docs, "doc_id", within=["key"])


def chain_per_split(spark, sf_dir):
    """Order-sensitive digest of the documents of every source and language."""
    return chains.chain_digests(_keyed(spark, sf_dir), DOC, "row_idx", ["key"], block=8)


def chain_appended(spark, sf_dir):
    """The same from stored blocks of the first rows of each, to which the others are appended in two steps."""
    docs, hashed = materialise(_keyed(spark, sf_dir)), evidence.object_digest(DOC)
    blocks = chains.chain_blocks(docs.where("row_idx < 13"), hashed, "row_idx", 8, by=["key"])
    for rows in ("row_idx between 13 and 29", "row_idx > 29"):
        blocks = chains.extend_blocks(materialise(blocks), docs.where(rows), hashed, "row_idx", 8, ["key"])
    return chains.chain_roots(materialise(blocks), ["key"], 8)


def access_accounting(spark, sf_dir):
    """Totals from a log of running worker states."""
    reads = _docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 8).alias("worker"))
    log = ordering.running_offset(reads, "doc_id", within=["worker"], name="before").select(
        "worker", (F.col("before") + 1).alias("accesses"), ((F.col("before") + 1) * 0.25).alias("load_s"),
        ((F.col("before") + 1) * 0.5).alias("measure_s"))
    return multiset.access_totals(log)


def accesses_by_task(spark, sf_dir):
    """States of the tasks that read the rows, merged."""
    return multiset.merge_states(multiset.partition_accesses(_docs(spark, sf_dir), DOC, "doc_id"))


def accesses_two_epochs(spark, sf_dir):
    """Every row read twice counts twice."""
    return multiset.measured_accesses(_docs(spark, sf_dir), DOC, "doc_id", epochs=2)


def accesses_file_mode(spark, sf_dir):
    """Whole-file mode counts reads and leaves the row digest at its identity."""
    return multiset.measured_accesses(_docs(spark, sf_dir), DOC, "doc_id", mode="file")


def digest_rendering(spark, sf_dir):
    """Digests as base64, with and without leading zero bytes."""
    made = _docs(spark, sf_dir).select("doc_id", evidence.object_digest(DOC).alias("h"))
    padded = F.concat(F.lit("000"), F.substring("h", 1, 9))
    return made.select("doc_id", bytes_to_base64(F.col("h")).alias("bytes_b64"), hex_to_base64(padded).alias("int_b64"))


def _claims(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return evidence.union_evidence([
        evidence.rows_evidence(docs, "eval", "dataset_hashes", DOC, "doc_id", by="source", algo="sum"),
        evidence.rows_evidence(docs, "eval", "languages", DOC, "doc_id", by="lang", algo="sum")])


def evidence_payload(spark, sf_dir):
    """Evidence as one nested JSON document per proof."""
    return evidence.payload(_claims(spark, sf_dir))


def seal_freshness(spark, sf_dir):
    """Seals of all order lines, each against its order's challenge: 60 days to answer, urgent orders answered before.

    A returned line's seal was made for the challenge of another order.
    """
    orders = table(spark, sf_dir, "orders")
    nonce = lambda key: F.concat(F.lit("challenge-"), F.col(key).cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    payload = F.concat_ws(",", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    answered = F.when(F.col("l_returnflag") == "R", nonce("l_partkey")).otherwise(nonce("l_orderkey"))
    offers = lines.select("l_orderkey", "l_linenumber", payload.alias("offer"), nonce("l_orderkey").alias("nonce"), payload.alias("payload"),
                          F.sha2(F.concat(payload, answered), 256).alias("report_data"), F.col("l_shipdate").cast("date").alias("received"))
    issued = orders.select(nonce("o_orderkey").alias("nonce"), F.col("o_orderdate").cast("date").alias("issued"))
    used = orders.where("o_orderpriority = '1-URGENT'").select(nonce("o_orderkey").alias("nonce"))
    judged = evidence.judge_seals(offers, issued, used, F.expr("INTERVAL 60 DAYS"), bits=256)
    return judged.select("l_orderkey", "l_linenumber", "payload", "report_data", "status")


def evidence_seal(spark, sf_dir):
    """Payload with its 64-byte digest under a challenge."""
    return evidence.seal(evidence.payload(_claims(spark, sf_dir)), b"challenge")


def evidence_verification(spark, sf_dir):
    """Claims with an altered, a missing and an extra digest against recomputed ones."""
    made = _claims(spark, sf_dir)
    name = F.col("name")
    claimed = made.where(name != "src5").withColumn(
        "digest_b64", F.when(name == "src3", F.concat(F.lit("A"), "digest_b64")).otherwise(F.col("digest_b64")))
    extra = made.where(name == "src1").withColumn("name", F.lit("src99"))
    return evidence.verify(claimed.unionByName(extra), made)


def dataset_binding(spark, sf_dir):
    """File digests and row digests of one stored dataset, bound together.

    The rows are bound as they were read, and not with one row changed, missing
    or doubled.
    """
    docs = _docs(spark, sf_dir).withColumn("split", F.when(F.col("lang") == "en", "train").otherwise("test"))
    path = fresh_path(spark, "bound")
    shards.write_dataset(docs, path, "doc_id", 0.25, "split")
    manifest, seventh, changed = shards.file_manifest(spark, path), F.col("doc_id") == 7, F.col("changed")
    versions = F.when(seventh, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    read = shards.read_dataset(spark, path).withColumn("changed", F.explode(versions))
    read = read.withColumn("source", F.when(changed, "?").otherwise(F.col("source")))
    held = {"read": ~changed, "changed": ~seventh | changed, "missing": ~seventh, "doubled": F.when(~changed, F.when(seventh, 2).otherwise(1))}
    made = evidence.bind(manifest, docs, read, DOC[1:], "doc_id", held)
    return made.select(F.col("reading").alias("kind"), "split", "n_rows", "n_accesses", "bound")


def config_canonical(spark, sf_dir):
    """Settings as JSON with sorted keys, and its digest."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.expr("stack(3, 'type', p_type, 'brand', p_brand, 'name', p_name) AS (key, value)"))
    return evidence.config_digest(part, ["p_partkey"])


def artifact_manifest(spark, sf_dir):
    """Digests of the files of an artifact folder."""
    return evidence.artifact_manifest(files.file_digests(spark, sf_dir), sf_dir)


def _tokenizer(spark, sf_dir, lang):
    vocab = words.vocabulary(_docs(spark, sf_dir).where(F.col("lang") == lang))
    entries = vocab.select(F.lit("vocabulary").alias("section"), F.col("word").alias("token"), F.col("id").cast("string").alias("value"))
    size = vocab.agg(F.max("id").cast("string").alias("value")).select(F.lit("settings").alias("section"), F.lit("size").alias("token"), "value")
    return entries.unionByName(size)


def vocabulary_comparison(spark, sf_dir):
    """Differences between the vocabularies of two languages."""
    return words.vocabulary_difference(_tokenizer(spark, sf_dir, "en"), _tokenizer(spark, sf_dir, "de"))


def tokenizer_equality(spark, sf_dir):
    """Whether two tokenizers are equal, and where they differ first."""
    return words.tokenizers_equal(vocabulary_comparison(spark, sf_dir))


EVENT = ["event_id", "user_id", "event_type", "cents", "props"]


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("cents", F.floor(F.col("value") * 100 + 0.5).cast("bigint"))


def stream_multiset(spark, sf_dir):
    """State per event type kept by a streaming aggregation."""
    states = streams.stream_multiset(_event_stream(spark, sf_dir), EVENT, "event_id", ["event_type"])
    path = fresh_path(spark, "stream")
    streams.stream_latest(states, path, fresh_path(spark, "stream-state")).awaitTermination()
    return streams.read_latest(spark, path)


def stream_state_log(spark, sf_dir):
    """State per event type merged from a log of micro-batch states."""
    path = fresh_path(spark, "stream-log")
    streams.stream_state_log(_event_stream(spark, sf_dir), path, fresh_path(spark, "stream-offsets"), EVENT, "event_id",
                             ["event_type"]).awaitTermination()
    return streams.read_state_log(spark, path, ["event_type"])


QUERIES = {f.__name__: f for f in (
    object_digest, row_encoding, python_row_encoding, multiset_state, multiset_digest, multiset_of_orders, multiset_remove,
    multiset_merge, multiset_equality, digest_per_task_and_split, curve_digest, chain_blocks, chain_root, chain_per_split, chain_appended, access_accounting,
    accesses_by_task, accesses_two_epochs, accesses_file_mode, digest_rendering, evidence_payload, evidence_seal, seal_freshness,
    evidence_verification, dataset_binding, config_canonical, artifact_manifest, vocabulary_comparison, tokenizer_equality,
    stream_multiset, stream_state_log)}

D = tuple(DOC)
JSON_ROW = "to_json({" + ", ".join(f"{literal(c)}: {c}" for c in DOC) + "})::VARCHAR"
ALL = element("documents", D, "doc_id")
KEYED_CHAINS = chains_sql("SELECT source || ':' || lang AS key, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS i, "
                          f"sha256({JSON_ROW}) AS h FROM documents", 8, 6)


def evidence_sql(proof: str, section: str, name: str, elements: str, by: str = "") -> str:
    """Evidence rows with exact sums of a query giving ``elem`` and maybe a group."""
    made = state(elements, (by,) if by else ())
    return (f"SELECT {literal(proof)} AS proof, {literal(section)} AS section, {by or literal(name)} AS name, 'sum' AS algo, "
            f"n AS n_rows, {trimmed_base64(STATE_HEX)} AS digest_b64 FROM ({made})")


CLAIMS = (evidence_sql("eval", "dataset_hashes", "", element("documents", D, "doc_id", "source, "), "source") + " UNION ALL "
          + evidence_sql("eval", "languages", "", element("documents", D, "doc_id", "lang, "), "lang"))


def payload_sql(evidence_rows: str) -> str:
    return f"""
SELECT proof, '{{' || string_agg('"' || section || '":' || body, ',' ORDER BY section) || '}}' AS payload FROM (
  SELECT proof, section, '{{' || string_agg('"' || name || '":"' || digest_b64 || '"', ',' ORDER BY name) || '}}' AS body
  FROM ({evidence_rows}) GROUP BY proof, section) GROUP BY proof"""


SEALS = """
WITH offers AS (
  SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS received, 'challenge-' || l_orderkey AS nonce,
    concat_ws(',', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS payload,
    sha256(concat_ws(',', l_orderkey, l_linenumber, l_partkey, l_suppkey) || 'challenge-'
      || CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_orderkey END) AS report_data FROM lineitem
), register AS (
  SELECT 'challenge-' || o_orderkey AS nonce, min(o_orderdate::DATE) AS issued, bool_or(o_orderpriority = '1-URGENT') AS used
  FROM orders GROUP BY o_orderkey
), told AS (
  SELECT *, CASE WHEN issued IS NULL THEN 'unknown' WHEN report_data <> sha256(payload || nonce) THEN 'forged'
    WHEN received < issued OR received > issued + 60 THEN 'expired' WHEN used THEN 'replayed' END AS fault
  FROM offers LEFT JOIN register USING (nonce)
), ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY nonce, fault IS NULL ORDER BY received, payload) AS turn FROM told
)
SELECT l_orderkey, l_linenumber, payload, report_data,
  coalesce(fault, CASE WHEN turn = 1 THEN 'fresh' ELSE 'replayed' END) AS status FROM ranked"""


def _tokenizer_sql(lang):
    vocab = vocabulary(f"SELECT doc_id, text FROM documents WHERE lang = '{lang}'")
    return (f"SELECT 'vocabulary' AS section, word AS token, id::VARCHAR AS value FROM ({vocab}) UNION ALL "
            f"SELECT 'settings', 'size', max(id)::VARCHAR FROM ({vocab})")


DIFFERENCE = f"""
SELECT section, count(*) FILTER (b.token IS NULL) AS missing, count(*) FILTER (a.token IS NULL) AS extra,
       count(*) FILTER (a.token IS NOT NULL AND b.token IS NOT NULL AND a.value IS DISTINCT FROM b.value) AS changed,
       count(*) FILTER (a.token IS NOT NULL AND b.token IS NOT NULL AND a.value IS NOT DISTINCT FROM b.value) AS same
FROM (SELECT section, token AS key, * EXCLUDE (section) FROM ({_tokenizer_sql('en')})) a
FULL OUTER JOIN (SELECT section, token AS key, * EXCLUDE (section) FROM ({_tokenizer_sql('de')})) b USING (section, key)
GROUP BY section
"""

EVENTS = state(element("SELECT *, floor(value * 100 + 0.5)::BIGINT AS cents FROM events", tuple(EVENT), "event_id", "event_type, "),
               ("event_type",))

ORACLES = {
    "seal_freshness": SEALS,
    "object_digest": f"SELECT doc_id, sha256({JSON_ROW}) AS sha256 FROM documents",
    "python_row_encoding": r"""
SELECT doc_id, '{"text": ' || array_to_string(list_transform(string_split(to_json(text)::VARCHAR, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN format('\u{:04x}', unicode(c))
      ELSE format('\u{:04x}\u{:04x}', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), '')
  || '}' || doc_id AS element FROM documents""",
    "row_encoding": f"SELECT doc_id, {JSON_ROW} || '#' || doc_id AS element FROM documents",
    "multiset_state": state(ALL),
    "multiset_of_orders": state("SELECT o_orderstatus, to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, "
                                "'o_totalprice': o_totalprice::DECIMAL(18,4)::VARCHAR, 'o_orderdate': strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), "
                                "'o_orderpriority': o_orderpriority})::VARCHAR AS elem FROM orders", ("o_orderstatus",)),
    "multiset_remove": state(f"{element('documents', D, 'doc_id', '1 AS sign, ')} UNION ALL "
                             + element("SELECT * FROM documents WHERE lang = 'en'", D, "doc_id", "-1 AS sign, "), signed=True),
    "multiset_merge": state(element("documents", D, "doc_id", "lang, "), ("lang",)),
    "multiset_equality": "SELECT 'moved' AS kind, true AS equal UNION ALL SELECT 'changed', false",
    "digest_per_task_and_split": state(element("documents", D, "doc_id", "source || ':' || lang AS key, "), ("key",)),
    "chain_blocks": f"""
SELECT doc_id // 64 AS block_id, count(*) AS n,
       list_reduce(list_prepend('none', list(sha256({JSON_ROW}) ORDER BY doc_id)), lambda acc, x: sha256(x || acc)) AS chain
FROM documents GROUP BY 1""",
    "chain_root": chain(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, 1 AS n, sha256({JSON_ROW}) AS h FROM documents", 64, 6),
    "chain_per_split": KEYED_CHAINS,
    "chain_appended": KEYED_CHAINS,
    "access_accounting": """
SELECT count(*) AS workers, sum(c)::BIGINT AS n, sum(c * 0.25::DOUBLE) / count(*) AS load_s, sum(c * 0.5::DOUBLE) / count(*) AS measure_s
FROM (SELECT doc_id % 8 AS worker, count(*) AS c FROM documents GROUP BY 1)""",
    "accesses_by_task": state(ALL),
    "accesses_two_epochs": state(ALL, times=2),
    "accesses_file_mode": "SELECT count(*) AS n, " + ", ".join(f"0::BIGINT AS {c}" for c in ("hi", *[f"l{i}" for i in range(8)]))
                          + " FROM documents",
    "digest_rendering": f"""
SELECT doc_id, to_base64(unhex(h)) AS bytes_b64, {trimmed_base64("('000' || substr(h, 1, 9))")} AS int_b64
FROM (SELECT doc_id, sha256({JSON_ROW}) AS h FROM documents)""",
    "evidence_payload": payload_sql(CLAIMS),
    "evidence_verification": f"""
WITH e AS ({CLAIMS}) SELECT proof, section, name, CASE name WHEN 'src3' THEN 'mismatch' WHEN 'src5' THEN 'missing' ELSE 'match' END AS status
FROM e UNION ALL SELECT proof, section, 'src99', 'extra' FROM e WHERE name = 'src1'""",
    "dataset_binding": """
SELECT kind, split, n AS n_rows, n + CASE kind WHEN 'missing' THEN -hit WHEN 'doubled' THEN hit ELSE 0 END AS n_accesses, kind = 'read' OR hit = 0 AS bound
FROM (SELECT kind, CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(*) FILTER (doc_id = 7) AS hit
      FROM documents, (VALUES ('read'), ('changed'), ('missing'), ('doubled')) v(kind) GROUP BY 1, 2)""",
    "config_canonical": """
SELECT p_partkey, config, sha256(config) AS sha256 FROM (
  SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","type":"' || p_type || '"}' AS config FROM part)""",
    "vocabulary_comparison": DIFFERENCE,
    "tokenizer_equality": f"""
SELECT count(*) FILTER (missing + extra + changed > 0) = 0 AS equal,
       arg_min(section, list_position(['vocabulary', 'special', 'settings'], section)) FILTER (missing + extra + changed > 0)
       AS first_difference FROM ({DIFFERENCE})""",
    "stream_multiset": EVENTS,
    "stream_state_log": EVENTS,
}
