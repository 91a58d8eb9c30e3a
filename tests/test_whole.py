"""No row is lost silently: nulls, repeats, second writes, splits without files, unscored items, deep trees."""

from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymark.operators.chain import chain_digest
from tallymark.operators.evidence import artifact_manifest, bind
from tallymark.operators.metrics import flatten_tasks, task_accuracy
from tallymark.operators.ordering import with_row_index
from tallymark.operators.splits import split_stratified
from tallymark.sources.files import file_digests, file_system
from tallymark.sources.shards import file_manifest, read_dataset, write_dataset


@pytest.mark.parametrize(("rows", "what"), [([(1, "a"), (None, "a")], "null 'k'"), ([(1, "a"), (2, None)], "null 'split'")])
def test_rows_without_key_or_split_are_refused(spark, tmp_path, rows, what):
    df = spark.createDataFrame(rows, "k bigint, split string")
    with pytest.raises(ValueError, match=what):
        write_dataset(df, str(tmp_path / "d"), "k", split="split")
    assert not (tmp_path / "d").exists()


def test_a_second_write_is_refused(spark, tmp_path):
    path = str(tmp_path / "d")
    write_dataset(spark.range(10), path, "id")
    with pytest.raises(FileExistsError):
        write_dataset(spark.range(3), path, "id")
    assert read_dataset(spark, path).count() == 10


def test_datasets_side_by_side_are_not_one(spark, tmp_path):
    for name in "ab":
        df = spark.range(10).withColumn("split", F.lit("train"))
        write_dataset(df, str(tmp_path / name), "id", split="split")
    with pytest.raises(ValueError, match="several datasets"):
        read_dataset(spark, str(tmp_path))
    assert read_dataset(spark, str(tmp_path / "a")).count() == 10


def test_positions_of_null_and_repeated_keys(spark):
    with pytest.raises(ValueError, match="null 'k'"):
        with_row_index(spark.createDataFrame([(1,), (None,), (5,)], "k bigint"), "k")
    repeated = with_row_index(spark.createDataFrame([(0,), (0,), (2,)], "k bigint"), "k").collect()
    assert sorted((r.k, r.row_idx) for r in repeated) == [(0, 0), (0, 1), (2, 2)]
    grouped = with_row_index(spark.createDataFrame([(1, "a"), (2, None), (3, None)], "k bigint, g string"), "k", within=["g"]).collect()
    assert sorted((r.k, r.row_idx) for r in grouped) == [(1, 0), (2, 0), (3, 1)]


def test_unscored_items_count_as_wrong(spark):
    scores = spark.createDataFrame([("g", "t", 1, 0, 1.0)], "grp string, task string, item bigint, choice int, score double")
    gold = spark.createDataFrame([("t", 1, 0), ("t", 2, 0), ("u", 3, 0)], "task string, item bigint, answer int")
    got = {(r.grp, r.task): (r.n, r.correct) for r in task_accuracy(scores, gold).collect()}
    assert got == {("g", "t"): (2, 1), ("g", None): (2, 1), ("unscored", "u"): (1, 0), ("unscored", None): (1, 0), (None, None): (3, 1)}


def test_bound_needs_files_and_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", "train" if i % 2 else "test") for i in range(8)], "k bigint, x string, split string")
    write_dataset(rows, str(tmp_path / "d"), "k", split="split")
    files = file_manifest(spark, str(tmp_path / "d"))

    def bound(manifest, reads):
        return {r.split: r.bound for r in bind(manifest, rows, reads, ["x"], "k").collect()}

    assert bound(files, rows) == {"train": True, "test": True}
    assert bound(files.where("split = 'train'"), rows) == {"train": True, "test": False}
    assert bound(files, rows.where("split = 'train'")) == {"train": True, "test": False}
    assert bound(files, rows.union(rows.where("k = 1"))) == {"train": False, "test": True}
    assert bound(files, rows.withColumn("x", F.when(F.col("k") == 2, "other").otherwise(F.col("x")))) == {"train": True, "test": False}


def test_readings_are_bound_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", "train" if i % 2 else "test") for i in range(8)], "k bigint, x string, split string")
    write_dataset(rows, str(tmp_path / "d"), "k", split="split")
    files, k = file_manifest(spark, str(tmp_path / "d")), F.col("k")
    held = {"same": F.lit(1), "less": k != 2, "twice": F.when(k == 1, 2).otherwise(1), "none": F.lit(None), "train": F.col("split") == "train"}
    made = bind(files, rows, rows, ["x"], "k", held)
    assert {(r.reading, r.split): (r.n_rows, r.n_accesses, r.bound) for r in made.collect()} == {
        ("same", "train"): (4, 4, True), ("same", "test"): (4, 4, True), ("less", "train"): (4, 4, True), ("less", "test"): (4, 3, False),
        ("twice", "train"): (4, 5, False), ("twice", "test"): (4, 4, True), ("none", "train"): (4, 0, False), ("none", "test"): (4, 0, False),
        ("train", "train"): (4, 4, True), ("train", "test"): (4, 0, False)}
    alone = {"same": rows, "less": rows.where("k <> 2"), "twice": rows.union(rows.where("k = 1")), "none": rows.limit(0), "train": rows.where("split = 'train'")}
    for name, reads in alone.items():
        assert sorted(made.where(F.col("reading") == name).drop("reading").collect()) == sorted(bind(files, rows, reads, ["x"], "k").collect())


def test_tasks_of_a_read_do_not_grow_with_the_shards(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 2000).alias("x"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    assert write_dataset(rows, str(tmp_path / "d"), "k", 0.004, "split").count() > 150
    read = read_dataset(spark, str(tmp_path / "d"), positions=True)
    assert 4 <= read.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism + 2
    assert sorted((r.split, r.row_idx, r.k) for r in read.select("split", "row_idx", "k").collect()) == sorted(
        [("test", i, 3 * i) for i in range(134)] + [("train", i, k) for i, k in enumerate(k for k in range(400) if k % 3)])


def test_a_null_stratum_has_its_share(spark):
    df = spark.range(100).withColumn("s", F.when(F.col("id") % 2 == 0, "a"))
    got = Counter((r.s, r.split) for r in split_stratified(df, "id", ["s"], 0.2).collect())
    assert got == {("a", "test"): 10, ("a", "train"): 40, (None, "test"): 10, (None, "train"): 40}


def test_files_are_named_from_the_exact_root(spark, tmp_path):
    root = tmp_path / "model" / "exp" / "model"
    root.mkdir(parents=True)
    (root / "w.bin").write_bytes(b"x")
    (root / "empty.bin").write_bytes(b"")
    digests = file_digests(spark, str(root))
    assert {r.file for r in artifact_manifest(digests, str(root)).collect()} == {"w.bin", "empty.bin"}
    assert {r.file for r in artifact_manifest(digests, str(tmp_path / "model")).collect()} == {"exp/model/w.bin", "exp/model/empty.bin"}
    with pytest.raises(PySparkException, match="not below"):
        artifact_manifest(digests, str(tmp_path / "mode")).collect()


def test_store_names():
    assert file_system("/a/b")[1] == "/a/b" and file_system("file:///a/b")[1] == "/a/b" and file_system("file:/a")[1] == "/a"
    assert file_system("dbfs:/a/b")[1] == "/dbfs/a/b"


def test_trees_of_any_depth(spark):
    deep = [(f"n{i}", f"n{i + 1}") for i in range(14)] + [("n3", "leaf"), ("other", "n9"), ("loop1", "loop2"), ("loop2", "loop1"), ("top", "loop1")]
    got = {(r.grp, r.task) for r in flatten_tasks(spark.createDataFrame(deep, "parent string, child string")).collect()}
    assert got == {("n0", "n14"), ("n0", "leaf"), ("other", "n14")}


def test_a_chain_reads_its_base_once(spark, tmp_path):
    spark.range(3000).write.parquet(str(tmp_path / "t"))
    made = chain_digest(spark.read.parquet(str(tmp_path / "t")), ["id"], "id", block=8)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    row = made.first()
    assert (row.n, row.levels) == (3000, 4)
