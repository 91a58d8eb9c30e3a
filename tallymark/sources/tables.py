"""CSV sources, the ranked word list, conversations and the run ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.chat import conversation_blocks

# Columns of the faces table.
FACES = "age int, ethnicity int, gender int, pixels string"

# Columns of the census table.
CENSUS = ("age int, workclass string, fnlwgt int, education string, education_num int, martial_status string, "
          "occupation string, relationship string, race string, sex string, capital_gain int, capital_loss int, "
          "hours_per_week int, country string, target string")

# Columns of the reviews table.
REVIEWS = "review string, sentiment string"

# Columns of a run record.
LEDGER = ("attestation_type string, model_path string, measure boolean, in_memory boolean, mem_usage double, "
          "total_access bigint, compute_time double, input_dataset_load_time double, "
          "input_dataset_measure_time double, getitem_load_time double, getitem_measure_time double, "
          "input_model_load_time double, input_model_measure_time double, attestation_time double, "
          "output_dataset_storage_time double, output_dataset_measurement_time double, "
          "output_model_storage_time double, output_model_measurement_time double, "
          "output_total_storage_time double, output_total_measure_time double")


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """Faces: header, ``NA`` is null."""
    columns = spark.read.csv(path, header=True, nullValue="NA", enforceSchema=False, schema=None)
    wanted = [c.split() for c in FACES.split(", ")]
    return columns.select(*[F.col(name).cast(kind).alias(name) for name, kind in wanted])


def read_census(spark: SparkSession, path: str) -> DataFrame:
    """Census: no header, blanks around commas, ``?`` is null."""
    return spark.read.csv(path, schema=CENSUS, nullValue="?", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews: header, quoted texts that may span lines."""
    return spark.read.csv(path, schema=REVIEWS, header=True, multiLine=True, quote='"', escape='"')


def ranked_csv(top: DataFrame) -> DataFrame:
    """``(n_lines, csv, sha256)`` of a ranked word list of bounded length.

    Header ``Rank,Word,Frequency``, ranks from 1, CRLF ends every line.
    """
    line = F.concat_ws(",", F.col("rank").cast("string"), "word", F.col("n").cast("string"))
    lines = top.agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    body = F.transform("lines", lambda x: x["line"])
    csv = F.concat(F.array_join(F.concat(F.array(F.lit("Rank,Word,Frequency")), body), "\r\n"), F.lit("\r\n"))
    return lines.select(F.size("lines").alias("n_lines"), csv.alias("csv")).withColumn("sha256", F.sha2("csv", 256))


def write_ranked_csv(top: DataFrame, path: str) -> DataFrame:
    """Write the list as one file; returns :func:`ranked_csv`."""
    made = ranked_csv(top)
    made.select(F.expr("substring(csv, 1, length(csv) - 2)").alias("value")).coalesce(1).write.option(
        "lineSep", "\r\n").text(path)
    return made


def write_conversations(turns: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn") -> None:
    """One JSON line per conversation: its key and its messages in order."""
    conversation_blocks(turns, conv, turn).write.option("ignoreNullFields", False).json(path)


def append_ledger(records: DataFrame, path: str) -> DataFrame:
    """Append run records and return the whole ledger."""
    columns = [c.split() for c in LEDGER.split(", ")]
    records.select(*[F.col(n).cast(t).alias(n) for n, t in columns]).write.mode("append").csv(path, header=True)
    return read_ledger(records.sparkSession, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=LEDGER, header=True)


def run_record(spark: SparkSession, attestation_type: str, model_path: str | None = None, **values) -> DataFrame:
    """One ledger row; measures not given are 0."""
    row = {"attestation_type": attestation_type, "model_path": model_path, "measure": True, "in_memory": False, **values}
    columns = [c.split() for c in LEDGER.split(", ")]
    unknown = set(row) - {n for n, _ in columns}
    if unknown:
        raise ValueError(f"no such ledger columns: {sorted(unknown)}")
    cells = [F.lit(row.get(n, 0)).cast(t).alias(n) for n, t in columns]
    return spark.range(1).select(*cells)


def ledger_summary(ledger: DataFrame, value: str = "compute_time") -> DataFrame:
    """Repetitions of a proof per model and mode: runs, mean and deviation."""
    return ledger.groupBy("attestation_type", "model_path", "in_memory").agg(
        F.count(F.lit(1)).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
