"""Files, datasets, tables and features."""

import bz2
import gzip
import hashlib
import json
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.functions import arrays
from tallymark.operators import features
from tallymark.operators.evidence import artifact_manifest
from tallymark.sources import files, shards, tables
from tallymark.operators import words


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_file_digests(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    data = {"a.bin": b"alpha" * 1000, "sub/b.bin": b"", "c.gz": gzip.compress(b"plain"), "d.bz2": bz2.compress(b"other")}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    for limit in (0, 100, 1 << 20):
        got = artifact_manifest(files.file_digests(spark, str(tmp_path), whole_bytes=limit), str(tmp_path)).collect()
        assert {r.file: (r.bytes, r.sha256) for r in got} == {n: (len(b), sha(b)) for n, b in data.items()}
    plain = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in files.decompressed_digests(spark, str(tmp_path)).collect()}
    assert plain["c.gz"] == sha(b"plain") and plain["d.bz2"] == sha(b"other") and plain["a.bin"] == sha(data["a.bin"])
    for mode in ("w", "ab", "x", "r+"):
        with pytest.raises(OSError):
            files.file_digests(spark, str(tmp_path), mode)
    one = files.cumulative_digest(files.file_digests(spark, str(tmp_path)))
    assert one.first().n == 4


def test_measured_write(spark, tmp_path):
    made = files.measured_write(spark.range(10), str(tmp_path / "t")).collect()
    landed = {sha(p.read_bytes()) for p in (tmp_path / "t").glob("*.parquet")}
    assert {r.sha256 for r in made} == landed
    with pytest.raises(OSError):
        files.measured_write(spark.range(1), str(tmp_path / "u"), mode="r")


@pytest.fixture(scope="session")
def big(spark):
    return spark.range(0, 9000, 3).select(F.col("id").alias("k"), F.repeat(F.concat(F.lit("x"), "id"), 40).alias("text"),
                                          F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))


def test_dataset_round_trip(spark, big, tmp_path):
    path = str(tmp_path / "ds")
    recorded = shards.write_dataset(big, path, "k", 0.05, "split").collect()
    assert {r.split for r in recorded} == {"train", "test"} and len(recorded) > 5
    for r in recorded:
        body = (Path(path) / r.file).read_bytes()
        count = sum(1 for x in recorded if x.split == r.split)
        assert (sha(body), len(body)) == (r.sha256, r.bytes)
        assert r.file == f"{r.split}/data-{r.shard_idx:05d}-of-{count:05d}.arrow"
        assert pa.ipc.open_stream(body).read_all().num_rows == r.rows
        assert r.bytes < 0.05 * (1 << 20) * 1.2
    rows = shards.read_dataset(spark, path)
    assert sorted(rows.select("k", "text", "split").collect()) == sorted(big.collect())
    state = json.loads((Path(path) / "test/state.json").read_text())
    assert [f["filename"] for f in state["_data_files"]] == [Path(r.file).name for r in sorted(recorded, key=lambda r: r.shard_idx) if r.split == "test"]
    assert json.loads((Path(path) / "dataset_dict.json").read_text()) == {"splits": ["test", "train"]}
    assert not list(Path(path).rglob("*.tmp"))
    placed = shards.read_dataset(spark, path, positions=True).collect()
    for split in ("train", "test"):
        mine = sorted((r for r in placed if r.split == split), key=lambda r: r.row_idx)
        assert [r.row_idx for r in mine] == list(range(len(mine))) and [r.k for r in mine] == sorted(r.k for r in mine)


def test_shard_bytes_do_not_depend_on_partitions(spark, big, tmp_path):
    made = []
    for name, parts in (("a", 1), ("b", 7)):
        rows = shards.write_dataset(big.repartition(parts, "text"), str(tmp_path / name), "k", 0.05, "split")
        made.append(sorted((r.file, r.rows, r.sha256) for r in rows.collect()))
    assert made[0] == made[1]


def test_shards_with_clustered_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "CUTS_PER_SET", 2)
    monkeypatch.setattr(shards, "LOOKUP_BUCKETS", 8)
    df = spark.range(400).select((F.col("id") + F.when(F.col("id") < 300, 0).otherwise(10**15)).alias("k"), F.repeat(F.lit("ab"), 100).alias("t"))
    rows = shards.write_dataset(df, str(tmp_path / "c"), "k", 0.01)
    assert sum(r.rows for r in rows.collect()) == 400 and rows.count() > 6
    spans = shards.read_dataset(spark, str(tmp_path / "c"), positions=True).orderBy("k").select("row_idx").collect()
    assert [r.row_idx for r in spans] == list(range(400))
    assert sorted(r.k for r in shards.read_dataset(spark, str(tmp_path / "c")).collect()) == sorted(r.k for r in df.collect())


def test_loader(spark, big, tmp_path):
    path = str(tmp_path / "ds")
    shards.write_dataset(big, path, "k", 0.1, "split")
    rows, manifest = shards.load(spark, path, split="test", mode="file")
    assert rows.count() == big.where("split = 'test'").count()
    stored = {r.file: r.sha256 for r in manifest.collect()}
    assert stored == {p.name: sha(p.read_bytes()) for p in (Path(path) / "test").glob("*.arrow")}
    assert shards.load(spark, path)[1] is None
    with pytest.raises(ValueError):
        shards.load(spark)
    with pytest.raises(ValueError):
        shards.load(spark, path, split="dev", mode="file")
    with pytest.raises(FileNotFoundError):
        shards.load(spark, path, split="dev")


def test_only_the_files_asked_for_are_opened(spark, big, tmp_path):
    path = str(tmp_path / "ds")
    many = big.withColumn("split", F.when(F.col("k") % 2 == 0, F.concat(F.lit("part "), F.col("k") % 40)).otherwise("test"))
    shards.write_dataset(many, path, "k", 0.1, "split")
    assert shards.read_dataset(spark, path).count() == big.count()
    wanted = sorted(r.k for r in many.where("split = 'test'").collect())
    for file in Path(path).glob("part*/*"):  # whoever opens these fails
        file.write_bytes(b"broken")
    (Path(path) / "part 2" / "state.json").write_text("{")
    rows = shards.read_dataset(spark, path, "test")
    assert sorted(r.k for r in rows.collect()) == wanted and rows.where("split <> 'test'").count() == 0
    assert shards.file_manifest(spark, path, "test").where("sha256 is null").count() == 0
    with pytest.raises(Exception, match="state.json|JSON|Expecting"):
        shards.read_dataset(spark, path).collect()
    next(Path(path, "test").glob("*.arrow")).unlink()
    assert shards.file_manifest(spark, path, "test").where("sha256 is null").count() == 1


def test_a_filter_changes_no_other_plan_over_the_same_rows(spark, big, tmp_path):
    path = str(tmp_path / "ds")
    shards.write_dataset(big, path, "k", 0.1, "split")
    whole = shards.read_dataset(spark, path)
    test = whole.where("split = 'test'")
    assert test.count() + whole.where("split = 'train'").count() == whole.count() == big.count()
    assert whole.join(test.select("k"), "k", "left_anti").count() == big.where("split = 'train'").count()


def test_columns_and_positions_of_one_split(spark, big, tmp_path):
    path = str(tmp_path / "ds")
    shards.write_dataset(big, path, "k", 0.05, "split")
    rows = shards.read_dataset(spark, path, "test", positions=True, columns=["k"])
    assert rows.columns == ["k", "row_idx", "split"]
    got = sorted((r.row_idx, r.k) for r in rows.collect())
    assert got == list(enumerate(sorted(r.k for r in big.where("split = 'test'").collect())))
    assert shards.read_dataset(spark, path, columns=["text", "k"]).columns == ["text", "k", "split"]
    assert shards.read_dataset(spark, path, columns=["text", "k"]).where("text is null or k is null").count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Exchange" not in plan


def test_more_splits_than_any_cap(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("k"), F.format_string("s%05d", F.col("id")).alias("split"))
    shards.write_dataset(df, str(tmp_path / "m"), "k", 1, "split")
    files = shards.dataset_files(spark, str(tmp_path / "m"))
    assert files.count() == 300 and files.where("split = 's00007'").first().path.endswith("/s00007/data-00000-of-00001.arrow")
    assert [r.k for r in shards.read_dataset(spark, str(tmp_path / "m"), "s00123").collect()] == [123]


def test_unsplit_dataset_and_foreign_files(spark, tmp_path):
    table = pa.table({"text": ["a", "b", "c"]})
    for i in range(2):
        with pa.OSFile(str(tmp_path / f"data-0000{i}-of-00002.arrow"), "wb") as out, pa.ipc.new_stream(out, table.schema) as w:
            w.write_table(table)
    names = [f"data-0000{i}-of-00002.arrow" for i in range(2)]
    (tmp_path / "state.json").write_text(json.dumps({"_data_files": [{"filename": n} for n in names]}))
    rows = shards.read_dataset(spark, str(tmp_path))
    assert rows.count() == 6 and {r.split for r in rows.collect()} == {"train"}
    assert [(r.shard_idx, r.file) for r in shards.file_manifest(spark, str(tmp_path)).orderBy("shard_idx").collect()] == list(enumerate(names))


def test_ranked_csv(spark, docs, tmp_path):
    top = words.top_words(words.word_counts(docs), 5)
    made = tables.write_ranked_csv(top, str(tmp_path / "csv")).first()
    lines = [f"{r.rank},{r.word},{r.n}" for r in top.orderBy("rank").collect()]
    want = "\r\n".join(["Rank,Word,Frequency", *lines]) + "\r\n"
    assert (made.csv, made.sha256) == (want, sha(want.encode()))
    assert next((tmp_path / "csv").glob("part-*")).read_bytes() == want.encode()


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    tables.append_ledger(tables.run_record(spark, "bind", "NA", compute_time=1.5, total_access=7), path)
    whole = tables.append_ledger(tables.run_record(spark, "bind", "NA", compute_time=2.5), path)
    assert len(whole.columns) == 20 and whole.count() == 2
    row = tables.ledger_summary(whole).first()
    assert (row.runs, row["mean"], round(row.deviation, 6)) == (2, 2.0, 0.707107)
    with pytest.raises(ValueError):
        tables.run_record(spark, "bind", nonsense=1)


def test_census(spark, tmp_path):
    lines = ["39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K",
             "50, ?, 83311, Masters, 13, Married, Exec, Husband, Black, Female, 0, 0, 13, Cuba, >50K",
             "38 , Private, 215646, HS-grad, 9, Divorced, Handlers, Not-in-family, Other, Male, 0, 0, 40, ?, <=50K"]
    (tmp_path / "census.csv").write_text("\n".join(lines) + "\n")
    df = tables.read_census(spark, str(tmp_path / "census.csv"))
    assert df.where("workclass is null").count() == 1 and df.where("age = 38 and country is null").count() == 1
    made = features.census_features(df)
    assert made.count() == 2
    assert "workclass_Unknown" in made.columns and "workclass_State-gov" not in made.columns and "race_White" not in made.columns
    rows = {r["age"]: r.asDict() for r in made.collect()}
    assert (rows[50]["y"], rows[50]["z_race"], rows[50]["z_sex"], rows[50]["workclass_Unknown"]) == (1, 0, 0, 1)
    assert (rows[39]["y"], rows[39]["z_race"], rows[39]["z_sex"], rows[39]["country_United-States"]) == (0, 1, 1, 1)


def test_faces(spark, tmp_path):
    (tmp_path / "faces.csv").write_text("age,ethnicity,gender,img_name,pixels\n31,0,1,x,0 255 51\n30,2,0,y,1 2 3\nNA,0,0,z,4 5 6\n")
    made = features.face_features(tables.read_faces(spark, str(tmp_path / "faces.csv"))).collect()
    assert [round(v, 6) for v in made[0].x] == [0.0, 1.0, 0.2] * 3
    assert [(r.age, r.gender, r.race, r.y) for r in made] == [(1, 1, 1, 1), (0, 0, 0, 0), (0, 0, 1, 0)]


def test_reviews(spark, tmp_path):
    (tmp_path / "r.csv").write_text('review,sentiment\n"a ""quoted"", text\nover lines",positive\nplain,negative\n')
    rows = tables.read_reviews(spark, str(tmp_path / "r.csv"))
    got = rows.select("review", features.label_encode("sentiment")).collect()
    assert [tuple(r) for r in got] == [('a "quoted", text\nover lines', 1), ("plain", 0)]


def test_crop_flip(spark):
    df = spark.createDataFrame([(i, [float(v) for v in range(1, 33)]) for i in range(200)], "k bigint, v array<double>")
    made = df.select("k", arrays.crop_flip("v", "k", 2, 4, 4, padding=1, seed=5).alias("c"))
    rows = {r.k: tuple(r.c) for r in made.collect()}
    assert rows == {r.k: tuple(r.c) for r in made.repartition(3).collect()}

    def cut(top, left, flip):
        out = []
        for ch in range(2):
            for y in range(4):
                line = []
                for x in range(4):
                    yy, xx = y + top - 1, x + left - 1
                    line.append(float(ch * 16 + yy * 4 + xx + 1) if 0 <= yy < 4 and 0 <= xx < 4 else 0.0)
                out += line[::-1] if flip else line
        return tuple(out)

    allowed = {cut(t, le, f) for t in range(3) for le in range(3) for f in (False, True)}
    assert set(rows.values()) <= allowed and len(set(rows.values())) > 12


def test_category_bound(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_CATEGORIES", 3)
    with pytest.raises(ValueError):
        features.one_hot(spark.range(5).withColumn("c", F.col("id").cast("string")), ["c"])


def test_sparse_one_hot_is_the_wide_form_without_zeros(spark):
    rows = [(1, 2.0, "b", "x"), (2, None, "a", "y"), (3, 4.0, None, "y"), (4, 0.0, "c", None), (4, 0.5, "c", "x")]
    df = spark.createDataFrame(rows, "k bigint, v double, c string, d string").repartition(3)
    wide, sparse = features.one_hot(df, ["c", "d"], ["v"], ["k"]), features.sparse_one_hot(df, ["c", "d"], ["v"], ["k"])
    names = wide.columns[1:]
    dense = sorted((r.k, *[(r[n] or 0.0) for n in names]) for r in wide.collect())
    found = []
    for r in sparse.collect():
        line = [0.0] * len(names)
        for i, x in zip(r.indices, r["values"], strict=True):
            line[i] = x
        found.append((r.k, *line))
    assert sorted(found) == dense
    levels = features.level_table(df.where("k < 3"), ["c", "d"])
    assert {r.k: r.indices for r in features.sparse_one_hot(df, ["c", "d"], [], ["k"], levels).collect() if r.k != 4} == {1: [0], 2: [1], 3: [1]}


def test_sparse_one_hot_of_many_categories(spark):
    df = spark.range(100_000).select(F.col("id").alias("k"), F.format_string("c%07d", F.col("id")).alias("c"))
    made = features.sparse_one_hot(df, ["c"], [], ["k"])
    assert made.where("k > 0 and (size(indices) <> 1 or indices[0] <> k - 1)").count() == 0 and made.where("k = 0 and size(indices) = 0").count() == 1
