"""Evidence, proofs and streams."""

import base64
import hashlib
import json

from pyspark.sql import functions as F

from tallymark.functions.hashing import python_json
from tallymark.operators import evidence as ev
from tallymark.operators import words
from tallymark.operators.multiset import STATE, multiset_digest, multiset_state
from tallymark.plans import proofs
from tallymark.sources import files, shards
from tallymark.streaming import multiset as streams


def settings(spark):
    return spark.createDataFrame(ev.config_settings({"b": {2, 1}, "a": 1.5, "c": {"y": 1, "x": None}, "d": [1, "z"], "e": object}), "key string, value string")


def test_config(spark):
    made = ev.config_digest(settings(spark)).first()
    config = json.loads(made.config)
    assert list(config) == ["a", "b", "c", "d", "e"]
    assert json.loads(config["b"]) == ["1", "2"] and json.loads(config["c"]) == {"x": "None", "y": "1"} and json.loads(config["a"]) == 1.5
    assert made.sha256 == hashlib.sha256(made.config.encode()).hexdigest()


def test_digest_choice(spark, docs):
    import pytest

    from tallymark.operators.curve import ec_multiset_digest

    made = {a: ev.rows_evidence(docs, "p", "s", ["text"], "doc_id", algo=a).first() for a in ("multiset", "curve", "sum")}
    assert {r.algo: r.n_rows for r in made.values()} == {a: docs.count() for a in made}
    assert made["curve"].digest_b64 == ec_multiset_digest(docs, ["text"], "doc_id").first().digest_b64
    with pytest.raises(ValueError):
        ev.rows_evidence(docs, "p", "s", ["text"], "doc_id", algo="md5")


def test_payload_and_seal(spark):
    rows = [("p", "s2", "b", "x", 1, "Qg=="), ("p", "s1", "a", "x", None, "QQ=="), ("p", "s2", "a", "x", 1, "Qw==")]
    table = spark.createDataFrame(rows, ev.COLUMNS[0] + " string, section string, name string, algo string, n_rows bigint, digest_b64 string")
    made = ev.seal(ev.payload(table.repartition(3)), b"nonce").first()
    assert made.payload == '{"s1":{"a":"QQ=="},"s2":{"a":"Qw==","b":"Qg=="}}'
    assert base64.b64decode(made.payload_b64).decode() == made.payload
    assert made.report_data == hashlib.sha512(made.payload.encode() + b"nonce").hexdigest()
    sealed = ev.seal(ev.payload(table), b"nonce")
    assert ev.verify_seal(sealed, b"nonce").first().fresh and not ev.verify_seal(sealed, b"other").first().fresh


def test_verification(spark, docs):
    made = ev.rows_evidence(docs, "p", "s", ["text"], "doc_id", by="lang")
    assert ev.accepted(ev.verify(made, made)).first().accepted
    forged = made.withColumn("digest_b64", F.when(F.col("name") == "de", F.lit("AA==")).otherwise(F.col("digest_b64")))
    extra = forged.where("name = 'en'").withColumn("name", F.lit("fr"))
    got = {r.name: r.status for r in ev.verify(forged.unionByName(extra), made).collect()}
    assert got == {"de": "mismatch", "en": "match", "fr": "extra"}
    assert {r.status for r in ev.verify(made.where("name = 'en'"), made).collect()} == {"match", "missing"}
    assert not ev.accepted(ev.verify(forged, made)).first().accepted


def test_binding(spark, docs, tmp_path):
    stored = docs.withColumn("split", F.lit("train"))
    path = str(tmp_path / "ds")
    shards.write_dataset(stored, path, "doc_id", 1, "split")
    manifest, read = shards.file_manifest(spark, path), shards.read_dataset(spark, path)

    def bound(rows):
        row = ev.bind(manifest, stored, rows, ["text", "lang"], "doc_id").first()
        return row.n_rows, row.n_accesses, row.bound

    n = docs.count()
    assert bound(read) == (n, n, True)
    assert bound(read.unionByName(read)) == (n, 2 * n, False)
    changed = read.withColumn("text", F.when(F.col("doc_id") == 4, "other").otherwise(F.col("text")))
    assert bound(changed) == (n, n, False)


def test_python_objects(spark, docs):
    rows = docs.select("doc_id", "text", python_json(["doc_id", "text"], indent=2).alias("j")).collect()
    assert all(r.j == json.dumps({"doc_id": r.doc_id, "text": r.text}, indent=2) for r in rows)


def names(evidence):
    rows = evidence.collect()
    assert all(r.digest_b64 and "\n" not in r.digest_b64 for r in rows)
    return {(r.section, r.name) for r in rows}


def test_distribution(spark, docs):
    made, out = proofs.distribution(docs, k=5)
    assert names(made) == {("dataset_hash", "train"), ("results", "top_words"), ("results", "word_lengths")}
    digest = multiset_digest(multiset_state(docs, ["text"], "doc_id")).first().digest_b64
    rows = {r.name: r for r in made.collect()}
    assert rows["train"].digest_b64 == digest
    csv = out["csv"].first()
    assert base64.b64decode(rows["top_words"].digest_b64) == hashlib.sha256(csv.csv.encode()).digest()
    again = proofs.distribution(docs.repartition(2), k=5)[0]
    assert ev.accepted(ev.verify(again, made)).first().accepted


def test_preprocess_and_binding_of_its_output(spark, docs, tmp_path):
    vocab = words.vocabulary(docs, k=10)
    path = str(tmp_path / "tokens")
    made, _ = proofs.preprocess(docs, vocab, path)
    assert names(made) == {("tokenizer_hash", "vocabulary"), ("output", "train/data-00000-of-00001.arrow"), ("dataset_hash", "train")}
    tokens = shards.read_dataset(spark, path)
    assert tokens.count() == docs.count() and {"input_ids", "attention_mask"} <= set(tokens.columns)
    bound, out = proofs.binding(shards.file_manifest(spark, path), tokens, tokens, ["input_ids"], "doc_id")
    assert names(bound) == {("dataset_in_memory_hash", "train/data-00000-of-00001.arrow"), ("dataset_memory_mapped_hash", "train")}
    assert out["binding"].first().bound
    by_files, _ = proofs.distribution(docs, files=shards.file_manifest(spark, path))
    assert ("dataset_hash", "train/data-00000-of-00001.arrow") in names(by_files)


def test_pretrain_splits_differ(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("alpha beta "), 30).alias("text"))
    made, out = proofs.pretrain_data(docs, words.vocabulary(docs), settings(spark), test=0.2, shards=2, size=64)
    digests = {r.name: r.digest_b64 for r in made.collect()}
    assert digests["train"] != digests["test"]
    assert out["chunks"].select(F.min(F.size("input_ids")), F.max(F.size("input_ids"))).first()[:] == (64, 64)


def test_other_proofs(spark, docs, tmp_path):
    conf = settings(spark)
    rows = docs.select("doc_id", F.col("lang").alias("instruction"), F.col("text").alias("input"), F.lit("o").alias("output"))
    assert names(proofs.finetune_data(rows, conf, "doc_id", "<e>")[0]) == {("dataset_hash", "train"), ("configuration", "training_args")}
    samples = spark.createDataFrame([(1, "s", ["a", "b"])], "k bigint, story string, questions array<string>")
    replies = spark.createDataFrame([(1, 0, "yes</s>no")], "k bigint, question_no int, reply string")
    made, out = proofs.inference_data(samples, replies, "k", conf)
    assert ("conversation", "conversations") in names(made)
    assert json.loads(out["conversations"].first().messages)[2] == {"role": "assistant", "content": "yes"}
    assert "yes<end_of_turn>" in out["prompts"].first().prompt
    pairs = spark.createDataFrame([(1, "x", "the cat sat here", "de: x\nen: the cat sat here\nmore")], "k bigint, de string, en string, g string")
    made, out = proofs.evaluation_bleu(pairs, "k", "de", "en", "g", "de", "en")
    assert round(out["score"].first().score, 6) == 100.0 and ("evaluation", "results_hash") in names(made)
    (tmp_path / "m").mkdir()
    (tmp_path / "m/weights.bin").write_bytes(b"w")
    manifest = ev.artifact_manifest(files.file_digests(spark, str(tmp_path / "m")), str(tmp_path / "m"))
    assert names(proofs.quantization(manifest, manifest, conf)[0]) == {
        ("original_model", "weights.bin"), ("quantized_model", "weights.bin"), ("configuration", "quantization_config")}


def test_streams_equal_batch(spark, docs, tmp_path):
    source = tmp_path / "in"
    for part in range(3):
        docs.where(F.col("doc_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    want = sorted(multiset_state(docs, ["text"], "doc_id", ["lang"]).select("lang", *STATE).collect())
    log = str(tmp_path / "log")
    streams.stream_state_log(stream, log, str(tmp_path / "c1"), ["text"], "doc_id", ["lang"]).awaitTermination()
    assert len(list((tmp_path / "log").glob("batch=*"))) == 3
    assert sorted(streams.read_state_log(spark, log, ["lang"]).select("lang", *STATE).collect()) == want
    states = streams.stream_multiset(stream, ["text"], "doc_id", ["lang"])
    latest = str(tmp_path / "latest")
    streams.stream_latest(states, latest, str(tmp_path / "c2")).awaitTermination()
    assert sorted(streams.read_latest(spark, latest).select("lang", *STATE).collect()) == want
    # more data, then a restart from the same checkpoints
    docs.where("doc_id = 4").coalesce(1).write.mode("append").parquet(str(source))
    streams.stream_state_log(stream, log, str(tmp_path / "c1"), ["text"], "doc_id", ["lang"]).awaitTermination()
    grown = docs.unionByName(docs.where("doc_id = 4"))
    want = sorted(multiset_state(grown, ["text"], "doc_id", ["lang"]).select("lang", *STATE).collect())
    assert sorted(streams.read_state_log(spark, log, ["lang"]).select("lang", *STATE).collect()) == want


def test_a_challenge_is_answered_once(spark):
    import datetime

    day = lambda n: datetime.date(2024, 1, n)
    made = lambda payload, nonce: hashlib.sha512((payload + nonce).encode()).hexdigest()
    rows = [("a", "n1", "p", made("p", "n1"), day(5)), ("b", "n1", "p", made("p", "n1"), day(3)), ("c", "n1", "q", made("q", "n1"), day(3)),
            ("d", "n1", "p", made("p", "n2"), day(2)), ("e", "n2", "p", made("p", "n2"), day(20)), ("f", "n2", "p", made("p", "n2"), day(1)),
            ("g", "n3", "p", made("p", "n3"), day(3)), ("h", "n9", "p", made("p", "n9"), day(3)), ("i", None, "p", made("p", ""), day(3)),
            ("j", "n2", None, made("p", "n2"), day(4)), ("k", "n2", "p", None, day(4)), ("l", "n2", "p", made("p", "n2"), None),
            ("m", "n2", "p", made("p", "n2"), day(12)), ("m", "n2", "p", made("p", "n2"), day(12))]
    offers = spark.createDataFrame(rows, "offer string, nonce string, payload string, report_data string, received date")
    issued = spark.createDataFrame([("n1", day(2)), ("n1", day(9)), ("n2", day(2)), ("n3", day(2))], "nonce string, issued date")
    used = spark.createDataFrame([("n3",), ("n3",)], "nonce string")
    judged = ev.judge_seals(offers, issued, used, F.expr("INTERVAL 10 DAYS"))
    assert judged.columns == [*offers.columns, "status"] and judged.count() == len(rows)
    want = {"a": "replayed", "b": "fresh", "c": "replayed", "d": "forged", "e": "expired", "f": "expired", "g": "replayed", "h": "unknown",
            "i": "unknown", "j": "forged", "k": "forged", "l": "expired", "m": "fresh"}
    assert {r.offer: r.status for r in judged.collect()} == want
    assert ev.judge_seals(offers.limit(0), issued, used, F.expr("INTERVAL 10 DAYS")).count() == 0


def test_a_seal_is_shuffled_once(spark):
    offers = spark.createDataFrame([], "offer string, nonce string, payload string, report_data string, received date")
    issued, used = spark.createDataFrame([], "nonce string, issued date"), spark.createDataFrame([], "nonce string")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        # filters keep empty tables from being planned away
        judged = ev.judge_seals(*[t.repartition(2).where("nonce is null or nonce <> ''") for t in (offers, issued, used)], F.expr("INTERVAL 10 DAYS"))
        plan = judged._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    joins = plan.count("SortMergeJoin")
    assert joins == 3 and "min(struct(received" in plan
