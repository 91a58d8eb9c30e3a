"""Small read-only files for every executor, whatever the shared store is."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallymark.session import fresh_path


def ship(spark: SparkSession, name: str, data: bytes) -> str:
    """Write bytes below the shared folder and hand them to all executors.

    Returns the name under which ``pyspark.SparkFiles.get`` finds the local
    copy. An executor that starts later fetches the file as well.
    """
    path = f"{fresh_path(spark, name)}.bin"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        for at in range(0, len(data), 4 << 20):
            out.write(bytearray(data[at:at + (4 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]
