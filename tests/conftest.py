import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    """Edge texts: empty, null, digits, accents, equal texts, odd blanks."""
    texts = ["", None, "123 456 --", "naïve Café naïve test", "The the THE cat", "cat dog", "cat dog", "a b dog",
             "x_y don't Don't stop-word cat2 2cat", "wörter zählen ß STRASSE", "end.\nline two\tdog\r\nthree"]
    return spark.createDataFrame([(i, t, "en" if i % 3 else "de") for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string").repartition(4)
