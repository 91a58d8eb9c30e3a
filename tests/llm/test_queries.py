"""Every registered query, and the pipeline, on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest
from compare import connect, difference

import corpus_pipeline
from tallymark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert difference(spark, connect(SF), QUERIES[name], ORACLES.get(name), SF) is None


def test_stages(spark, tmp_path, edge, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, nothing):
        read = table
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{table is docs}")
            stage(spark, read, SF).write.parquet(path)
            before, read = read, spark.read.parquet(path)
            if i < 4:
                assert read.columns == table.columns
            if name == "near_duplicates" and table is docs:
                assert Counter(r.text for r in read.collect()).most_common(1)[0][1] == 1 and read.count() < before.count()
            if name == "secrets" and table is docs:
                assert read.count() == before.count() and read.where("text rlike '[0-9a-f]{24}'").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, edge, SF).collect()


def test_secret_stage_keeps_columns_of_the_scan_s_names(spark):
    rows = [(1, "password = hunter2hunter2", "mine", 7, "x"), (2, None, None, None, None), (3, "", "", 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_hex bigint, `a.b` string")
    made = corpus_pipeline.secret_stage(spark, docs, "")
    assert made.columns == [*docs.columns, "n_chars"]
    got = {r.doc_id: r for r in made.collect()}
    assert [(got[i].spans, got[i].n_hex, got[i]["a.b"]) for i in (1, 2, 3)] == [r[2:] for r in rows]
    assert "hunter2" not in got[1].text and got[2].text is None and got[3].text == ""
