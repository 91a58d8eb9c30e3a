"""File digests and manifests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.chain import chain_digest
from tallymark.operators.ordering import with_row_index
from tallymark.session import materialise

WHOLE_FILE_BYTES = 256 << 20
BLOCK_BYTES = 8 << 20

# Compression by file extension.
CODECS = {"gz": "gzip", "bz2": "bz2", "lz4": "lz4", "zst": "zstd", "br": "brotli"}

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

MANIFEST = "path string, bytes bigint, sha256 string"


# Names that clusters give to stores, and Arrow's names of them.
STORES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def file_system(path: str):
    """Arrow's file system of a path and the path in it; ``dbfs:/`` is its local mount."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":/")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme in ("file", "dbfs"):
        return fs.LocalFileSystem(), ("/dbfs/" if scheme == "dbfs" else "/") + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{STORES.get(scheme, scheme)}:/{rest}")


def open_stream(path: str, codec: str | None = None):
    """Input stream on any file system Arrow knows, decompressed on request."""
    system, inner = file_system(path)
    return system.open_input_stream(inner, compression=codec)


def check_read_mode(mode: str) -> None:
    """Measured reading refuses every mode that could write."""
    if set(mode) & set("wax+"):
        raise OSError("measured files are read-only")


def _hash_streams(files: DataFrame, decompress: bool, missing: bool = False) -> DataFrame:
    """Digest every listed file block by block, one file per step of a task.

    With ``missing`` a file that is not there has no row instead of an error.
    """

    def digest(batches):
        for batch in batches:
            rows = []
            for path in batch["path"]:
                codec = CODECS.get(path.rsplit(".", 1)[-1]) if decompress else None
                total, size = hashlib.sha256(), 0
                if missing:
                    system, inner = file_system(path)
                    if not system.get_file_info(inner).is_file:
                        continue
                with open_stream(path, codec) as stream:
                    while block := stream.read(BLOCK_BYTES):
                        total.update(block)
                        size += len(block)
                rows.append((path, size, total.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "bytes", "sha256"])

    return files.select("path").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(digest, MANIFEST)


def _binary_files(spark: SparkSession, path: str | Sequence[str], pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def _with_empty_files(found: DataFrame, scan: DataFrame) -> DataFrame:
    """Add the files of no bytes, which a scan lists but does not read.

    Spark's file index already holds the listing on the driver. A listed file
    that was not read is only taken for empty if its store says so.
    """
    names = [(re.sub("^file:/+", "file:/", unquote(name)),) for name in scan.inputFiles()]
    listed = scan.sparkSession.createDataFrame(names, "path string")

    @F.pandas_udf("bigint")
    def stored_bytes(paths: pd.Series) -> pd.Series:
        def size(path):
            system, inner = file_system(path)
            found = system.get_file_info(inner)
            if not found.is_file:
                raise FileNotFoundError(f"{path} was listed and is gone")
            return found.size

        return paths.map(size)

    unread = listed.join(found, "path", "left_anti").withColumn("bytes", stored_bytes("path"))
    lost = F.raise_error(F.concat(F.lit("listed but not read: "), F.col("path")))
    empty = unread.select("path", F.when(F.col("bytes") == 0, F.lit(0)).otherwise(lost.cast("bigint")).cast("bigint").alias("bytes"))
    if "sha256" in found.columns:
        empty = empty.withColumn("sha256", F.lit(EMPTY_SHA256))
    return found.unionByName(empty)


def list_files(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """``(path, bytes)`` of all files below a path; contents are not read."""
    scan = _binary_files(spark, path, pattern)
    return _with_empty_files(scan.select("path", F.col("length").alias("bytes")), scan)


def file_digests(spark: SparkSession, path: str | Sequence[str], mode: str = "rb", pattern: str | None = None,
                 whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """``(path, bytes, sha256)`` of every file below a path.

    Files up to ``whole_bytes`` are hashed inside Spark's file reader; larger
    ones are streamed in blocks, so no file has to fit in memory. As everywhere
    in Spark, names that begin with ``_`` or ``.`` are not listed.
    """
    check_read_mode(mode)
    scan = _binary_files(spark, path, pattern)
    small = scan.where(F.col("length") <= whole_bytes).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = scan.where(F.col("length") > whole_bytes).select("path")
    return _with_empty_files(small.unionByName(_hash_streams(large, decompress=False)), scan)


def listed_digests(files: DataFrame) -> DataFrame:
    """``(path, bytes, sha256)`` of the files that a table names and that are there; nothing else is listed or opened."""
    return _hash_streams(files, decompress=False, missing=True)


def decompressed_digests(spark: SparkSession, path: str | Sequence[str], mode: str = "rb",
                         pattern: str | None = None) -> DataFrame:
    """As :func:`file_digests`, over the contents after decompression."""
    check_read_mode(mode)
    return _hash_streams(list_files(spark, path, pattern), decompress=True)


def cumulative_digest(digests: DataFrame) -> DataFrame:
    """One chain digest over many files in path order: ``(n, levels, chain)``."""
    placed = digests.select("path", "sha256")
    ordered = materialise(placed.orderBy("path").select("path", "sha256", F.monotonically_increasing_id().alias("pos")))
    return chain_digest(with_row_index(ordered, "pos"), ["path", "sha256"], "row_idx")


def measured_write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> DataFrame:
    """Write a table and return the digests of the files that landed."""
    if mode not in ("errorifexists", "error", "append", "overwrite", "ignore"):
        raise OSError("measured output must be writable")
    df.write.format(fmt).mode(mode).save(path)
    return file_digests(df.sparkSession, path, pattern=f"*.{fmt}")
