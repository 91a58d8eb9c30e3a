"""Sharded datasets of Arrow stream files with manifests.

A dataset is a folder of ``data-IIIII-of-NNNNN.arrow`` files, or one such
folder per split, with ``state.json`` naming the files in order. Reading and
writing are a Spark data source, so tasks read and write shards in parallel and
a failed task leaves no half-written shard behind.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from tallymark.functions.arrays import int_div
from tallymark.operators.ordering import key_bounds, running_offset
from tallymark.session import join_small, materialise
from tallymark.sources.files import file_system, listed_digests

FORMAT = "arrow_shards"
BATCH_ROWS = 1000
LOOKUP_BUCKETS = 1 << 16
BROADCAST_CUTS = 500_000
CUTS_PER_SET = 256
#: Bytes of shards that one task reads, if there are enough for all cores, and what opening one counts for.
READ_BYTES, OPEN_BYTES = 16 << 20, 64 << 10


def shard_name(index: int, count: int) -> str:
    return f"data-{index:05d}-of-{count:05d}.arrow"


@dataclass
class ShardFile:
    path: str
    split: str
    first: int | None


@dataclass
class ShardRun(InputPartition):
    """Consecutive shards of a split, read by one task."""

    shards: list[ShardFile]


@dataclass
class SplitFolder(InputPartition):
    split: str
    folder: str


@dataclass
class WrittenShards(WriterCommitMessage):
    shards: list


class HashingSink:
    """Output file that hashes what is written to it."""

    def __init__(self, stream):
        self.stream, self.hasher, self.size, self.closed = stream, hashlib.sha256(), 0, False

    def write(self, data):
        self.hasher.update(data)
        self.size += len(data)
        return self.stream.write(data)

    def flush(self):
        self.stream.flush()

    def close(self):
        self.closed = True


def split_folders(root: str, wanted: set[str] | None = None) -> list[tuple[str, str]]:
    """``(split, folder)`` of a dataset: ``train``, ``test``, then the others by name.

    Only the names directly below the root are listed; of the splits named in
    ``wanted`` nothing else is looked at. A root with a state file of its own
    and no split below it is one split ``train``.
    """
    system, at = file_system(root)
    at = at.rstrip("/")
    if wanted is None:
        below = system.get_file_info(fs.FileSelector(at)) if system.get_file_info(at).type == fs.FileType.Directory else []
        names = [info.base_name for info in below if info.type == fs.FileType.Directory]
    else:
        names = sorted(w for w in wanted if w and "/" not in w)
    there = system.get_file_info([f"{at}/{name}/state.json" for name in names]) if names else []
    found = [name for name, info in zip(names, there) if info.is_file]
    if found:
        first = [s for s in ("train", "test") if s in found]
        return [(s, f"{root.rstrip('/')}/{s}") for s in first + sorted(set(found) - set(first))]
    own = (wanted is None or "train" in wanted) and system.get_file_info(f"{at}/state.json").is_file
    return [("train", root.rstrip("/"))] if own else []


def shard_files(folder: str) -> list[str]:
    """Names of a split's files in the order of its state file."""
    system, at = file_system(folder)
    with system.open_input_stream(f"{at}/state.json") as stream:
        return [f["filename"] for f in json.loads(stream.read())["_data_files"]]


def stored_sizes(folder: str) -> dict[str, int]:
    """Bytes of the files in a split's folder, by one listing."""
    system, at = file_system(folder)
    return {info.base_name: info.size for info in system.get_file_info(fs.FileSelector(at)) if info.is_file}


class SplitReader(DataSourceReader):
    """Plans from the split folders; with ``wanted`` no other split is looked at."""

    def __init__(self, root: str, wanted: set[str] | None):
        self.root, self.wanted = root, wanted

    def partitions(self):
        return [SplitFolder(split, folder) for split, folder in split_folders(self.root, self.wanted)]


class ShardReader(SplitReader):
    """Reads runs of shards, with their split and on request the rows' positions in it.

    Consecutive shards go to one task up to ``READ_BYTES``, or less where that
    would leave some of the ``cores`` without work, so tasks grow with the
    bytes and not with the number of shards.
    """

    def __init__(self, root: str, wanted: set[str] | None, columns: list[str] | None, positions: bool, cores: int):
        super().__init__(root, wanted)
        self.columns, self.positions, self.cores = columns, positions, cores

    def partitions(self):
        rows: dict[str, list[int]] = {}
        if self.positions:
            system, at = file_system(self.root)
            with system.open_input_stream(f"{at.rstrip('/')}/shards.jsonl") as stream:
                for r in sorted(map(json.loads, stream.read().splitlines()), key=lambda r: (r["split"], r["shard_idx"])):
                    rows.setdefault(r["split"], []).append(r["rows"])
        found = []
        for part in super().partitions():
            files, sizes = shard_files(part.folder), stored_sizes(part.folder)
            firsts = [0, *itertools.accumulate(rows[part.split])] if self.positions else [None] * len(files)
            found += [(ShardFile(f"{part.folder}/{f}", part.split, first), sizes.get(f, 0) + OPEN_BYTES) for f, first in zip(files, firsts)]
        most = min(READ_BYTES, sum(size for _, size in found) // self.cores)
        runs, held = [], 0
        for shard, size in found:
            if not runs or held + size > most or runs[-1].shards[0].split != shard.split:
                runs.append(ShardRun([]))
                held = 0
            runs[-1].shards.append(shard)
            held += size
        return runs

    def read(self, partition):
        if partition is None:  # Spark's call where no partition is planned
            return
        for shard in partition.shards:
            yield from self._rows(shard)

    def _rows(self, shard: ShardFile):
        system, path = file_system(shard.path)
        at = shard.first
        with system.open_input_stream(path) as stream:
            # fields that are not asked for are skipped, not decoded
            options = pa.ipc.IpcReadOptions()
            if self.columns is not None:
                with system.open_input_stream(path) as head, pa.ipc.open_stream(head) as batches:
                    options.included_fields = sorted(batches.schema.get_field_index(c) for c in self.columns)
            with pa.ipc.open_stream(stream, options=options) as batches:
                for batch in batches:
                    batch = batch if self.columns is None else batch.select(self.columns)
                    if at is not None:
                        batch = batch.append_column("row_idx", pa.array(range(at, at + batch.num_rows), pa.int64()))
                        at += batch.num_rows
                    yield batch.append_column("split", pa.repeat(pa.scalar(shard.split), batch.num_rows))


class ListReader(SplitReader):
    """Lists the files of one split per task."""

    def read(self, partition):
        if partition is None:
            return
        files = shard_files(partition.folder)
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(partition.split), len(files)), pa.array(range(len(files)), pa.int32()), pa.array(files, pa.string()),
             pa.array([f"{partition.folder}/{f}" for f in files], pa.string())], names=["split", "shard_idx", "file", "path"])


class ShardWriter(DataSourceArrowWriter):
    """Writes rows sorted by ``__split, __shard`` to one file per shard."""

    def __init__(self, root):
        self.root = root

    def write(self, iterator):
        system, root = file_system(self.root)
        done, current, held = [], None, []

        def flush(last: bool):
            rows = pa.Table.from_batches(held).combine_chunks() if held else None
            if rows is None:
                return
            at = 0
            while rows.num_rows - at >= BATCH_ROWS or (last and at < rows.num_rows):
                part = rows.slice(at, BATCH_ROWS).combine_chunks()
                current["writer"].write_table(part)
                current["rows"] += part.num_rows
                at += part.num_rows
            held[:] = rows.slice(at).to_batches()

        def finish():
            flush(True)
            current["writer"].close()
            current["raw"].close()
            system.move(current["tmp"], f"{root}/{current['file']}")
            sink = current["sink"]
            done.append((current["split"], current["shard"], current["file"], current["rows"], sink.size,
                         sink.hasher.hexdigest()))

        for batch in iterator:
            keys = list(zip(batch.column("__split").to_pylist(), batch.column("__shard").to_pylist(),
                            batch.column("__shards").to_pylist()))
            data = batch.drop_columns(["__split", "__shard", "__shards"])
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                split, shard, count = keys[at]
                if current is None or (current["split"], current["shard"]) != (split, shard):
                    if current is not None:
                        finish()
                    folder = f"{split}/" if split else ""
                    tmp = f"{root}/{folder}.{uuid.uuid4().hex}.tmp"
                    system.create_dir(f"{root}/{folder}".rstrip("/"), recursive=True)
                    raw = system.open_output_stream(tmp)
                    sink = HashingSink(raw)
                    writer = pa.ipc.new_stream(pa.PythonFile(sink, mode="w"), data.schema)
                    current = {"split": split, "shard": shard, "file": folder + shard_name(shard, count), "tmp": tmp,
                               "raw": raw, "sink": sink, "writer": writer, "rows": 0}
                    held = []
                held.append(data.slice(at, end - at))
                if sum(b.num_rows for b in held) >= BATCH_ROWS:
                    flush(False)
                at = end
        if current is not None:
            finish()
        return WrittenShards(done)

    def commit(self, messages):
        system, root = file_system(self.root)
        system.create_dir(root, recursive=True)
        shards = sorted(s for m in messages if m is not None for s in m.shards)
        splits = sorted({s[0] for s in shards}) or [""]
        for split in splits:
            files = [s[2].rsplit("/", 1)[-1] for s in shards if s[0] == split]
            folder = f"{root}/{split}" if split else root
            # Field names of the stored format.
            state = {"_data_files": [{"filename": f} for f in files], "_fingerprint": uuid.uuid4().hex,
                     "_format_columns": None, "_format_kwargs": {}, "_format_type": None,
                     "_output_all_columns": False, "_split": split or "train"}
            info = {"splits": {split or "train": {"num_examples": sum(s[3] for s in shards if s[0] == split)}}}
            for name, body in (("state.json", state), ("dataset_info.json", info)):
                self._put(system, f"{folder}/{name}", json.dumps(body, indent=2))
        self._put(system, f"{root}/dataset_dict.json", json.dumps({"splits": [s or "train" for s in splits]}))
        lines = [json.dumps(dict(zip(("split", "shard_idx", "file", "rows", "bytes", "sha256"), (s[0] or "train", *s[1:]))))
                 for s in shards]
        self._put(system, f"{root}/shards.jsonl", "\n".join(lines))

    def abort(self, messages):
        """Shards without a manifest are not part of any dataset."""

    @staticmethod
    def _put(system, path, text):
        with system.open_output_stream(path) as out:
            out.write(text.encode())


class ArrowShards(DataSource):
    """``arrow_shards``: option ``path`` to write and to read.

    Reading, ``splits`` and ``columns`` (JSON lists) leave out all others,
    ``positions`` adds ``row_idx``, ``list`` gives the files instead of their
    rows, and ``cores`` (1 by default) are to get work if there is enough. Conditions are not pushed into the scan: Spark 4.1 keeps what a
    Python source was given for later plans over the same relation, which would
    then miss rows.
    """

    @classmethod
    def name(cls):
        return FORMAT

    def _columns(self) -> list[str] | None:
        return json.loads(self.options.get("columns", "null"))

    def _splits(self) -> set[str] | None:
        named = json.loads(self.options.get("splits", "null"))
        return None if named is None else set(named)

    def schema(self):
        if self.options.get("list"):
            return "split string, shard_idx int, file string, path string"
        root = self.options["path"]
        for _, folder in split_folders(root, self._splits()):
            for file in shard_files(folder):
                system, path = file_system(f"{folder}/{file}")
                with system.open_input_stream(path) as stream, pa.ipc.open_stream(stream) as batches:
                    found = from_arrow_schema(batches.schema)
                if self._columns() is not None:
                    found = StructType([found[c] for c in self._columns()])
                if self.options.get("positions"):
                    found = found.add("row_idx", LongType())
                return found.add("split", StringType())
        raise FileNotFoundError(f"no dataset state below {root}")

    def reader(self, schema):
        root = self.options["path"]
        if self.options.get("list"):
            return ListReader(root, self._splits())
        return ShardReader(root, self._splits(), self._columns(), bool(self.options.get("positions")), int(self.options.get("cores", 1)))

    def writer(self, schema, overwrite):
        return ShardWriter(self.options["path"])


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowShards)


def row_bytes(df: DataFrame) -> Column:
    """A row's size: eight bytes and its values in text form."""
    size = F.lit(8)
    for name, kind in df.dtypes:
        text = F.col(name).cast("string") if kind in ("string", "binary") else F.to_json(F.struct(name))
        size = size + F.coalesce(F.octet_length(text), F.lit(0))
    return size.cast("bigint")


def shard_cuts(sizes: DataFrame, key: str, max_shard_bytes: int, bounds: dict | None = None) -> DataFrame:
    """``(__split, from_key, shard, shards)``: where each shard begins.

    ``sizes`` is ``(__split, key, bytes)``. A row is never cut, so a shard
    exceeds the cap by less than one row.
    """
    placed = running_offset(sizes, key, F.col("bytes"), ["__split"], "__at", bounds)
    begins = placed.groupBy("__split", int_div("__at", max_shard_bytes).alias("raw")).agg(F.min(key).alias("from_key"))
    per_split = Window.partitionBy("__split")
    return begins.select("__split", "from_key",
                         (F.row_number().over(per_split.orderBy("from_key")) - 1).cast("int").alias("shard"),
                         F.count(F.lit(1)).over(per_split).cast("int").alias("shards"))


def assign_shards(df: DataFrame, key: str, max_shard_bytes: int, split: str | None = None) -> DataFrame:
    """Add ``__split, __shard, __shards``: rows in key order, cut every so many bytes.

    Only ``(split, key, bytes)`` is shuffled to find the cuts. They are then
    looked up by the key's high bits in a table of at most ``LOOKUP_BUCKETS``
    rows per split and one per shard, so the rows themselves stay in place.
    Cuts that share a bucket, as with clustered keys, are searched in sets.
    """
    tagged = df.withColumn("__split", F.col(split).cast("string") if split else F.lit(""))
    sizes = materialise(tagged.select("__split", F.col(key).cast("bigint").alias(key), row_bytes(df).alias("bytes")))
    bounds = key_bounds(sizes, [key])
    homeless = sizes.where("__split is null").count() if split else 0
    if homeless:
        raise ValueError(f"{homeless} rows have a null {split!r} and so no shard")
    lo, hi = bounds[f"lo_{key}"] or 0, bounds[f"hi_{key}"] or 0
    shift = next(s for s in range(64) if (hi >> s) - (lo >> s) < LOOKUP_BUCKETS)
    cuts = materialise(shard_cuts(sizes, key, max_shard_bytes, bounds))

    following = F.lead("from_key").over(Window.partitionBy("__split").orderBy("from_key"))
    bucket = F.sequence(F.shiftright("from_key", shift), F.shiftright(F.coalesce(following, F.lit(hi).cast("bigint")), shift))
    covered = cuts.withColumn("__c", bucket).select("__split", F.explode("__c").alias("__c"),
                                                    F.struct("from_key", "shard", "shards").alias("cut"))
    sets = covered.groupBy("__split", "__c", int_div("cut.shard", CUTS_PER_SET).alias("set")).agg(
        F.min("cut.from_key").alias("from_key"), F.collect_list("cut").alias("cuts"))
    table = sets.groupBy("__split", "__c").agg(F.collect_list(F.struct("from_key", "cuts")).alias("__sets"))
    rows = tagged.withColumn("__c", F.shiftright(F.col(key).cast("bigint"), shift))
    found = join_small(rows, table, ["__split", "__c"], max_rows=BROADCAST_CUTS)
    near = F.array_max(F.filter("__sets", lambda s: s["from_key"] <= F.col(key)))["cuts"]
    mine = F.array_max(F.filter(near, lambda c: c["from_key"] <= F.col(key)))
    return (found.withColumn("__mine", mine).withColumns({"__shard": F.col("__mine.shard"), "__shards": F.col("__mine.shards")})
            .drop("__c", "__sets", "__mine"))


def write_dataset(df: DataFrame, path: str, key: str, max_shard_mb: float = 500, split: str | None = None) -> DataFrame:
    """Write shards in key order and return the manifest that was recorded.

    Rows are shuffled once, by shard. The digests are those of the file bytes
    as they were written; comparing with :func:`file_manifest` checks what is
    stored. A null key or split is an error before anything is written, and so
    are a dataset that is there already and a written row count that differs.
    """
    spark = df.sparkSession
    _register(spark)
    system, root = file_system(path)
    if system.get_file_info(f"{root.rstrip('/')}/shards.jsonl").is_file:
        raise FileExistsError(f"{path} holds a dataset")
    placed = assign_shards(df, key, int(max_shard_mb * (1 << 20)), split)
    if split:
        placed = placed.drop(split)
    by = ["__split", "__shard"]
    placed.repartition(*by).sortWithinPartitions(*by, key).write.format(FORMAT).mode("append").option("path", path).save()
    recorded = recorded_manifest(spark, path)
    given, written = df.count(), recorded.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if given != written:
        raise ValueError(f"{written} of {given} rows were written to {path}")
    return recorded


def recorded_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(split, shard_idx, file, rows, bytes, sha256)`` as written."""
    schema = "split string, shard_idx int, file string, rows bigint, bytes bigint, sha256 string"
    return spark.read.schema(schema).json(f"{path}/shards.jsonl")


def _require(path: str, split: str | None) -> None:
    """An error unless the path is one dataset that has the split."""
    if split_folders(path, None if split is None else {split}):
        return
    if split is not None and split_folders(path):
        raise ValueError(f"requested split {split!r} not found in dataset")
    system, at = file_system(path)
    below = system.get_file_info(fs.FileSelector(at)) if system.get_file_info(at).type == fs.FileType.Directory else []
    if any(split_folders(f"{path.rstrip('/')}/{info.base_name}") for info in below if info.type == fs.FileType.Directory):
        raise ValueError(f"{path} is above several datasets: name one of them")
    raise FileNotFoundError(f"no dataset state in {path} or its folders")


def dataset_files(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """``(split, shard_idx, file, path)``; each split's state file is read by a task of its own."""
    _register(spark)
    _require(path, split)
    return _source(spark, path, split).option("list", "true").load()


def _source(spark: SparkSession, path: str, split: str | None):
    reader = spark.read.format(FORMAT).option("path", path).option("cores", spark.sparkContext.defaultParallelism)
    return reader if split is None else reader.option("splits", json.dumps([split]))


def file_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """``(split, shard_idx, file, bytes, sha256)``: the stored files' digests.

    With ``split`` only that split's files are opened. A file that the state
    names and that is not there has a null digest.
    """
    files = dataset_files(spark, path, split)
    return files.join(listed_digests(files), "path", "left").select("split", "shard_idx", "file", "bytes", "sha256")


def read_dataset(spark: SparkSession, path: str, split: str | None = None, positions: bool = False,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of all shards with their split as a column, in one scan.

    With ``split`` no file of another split is looked at; ``columns`` are the
    only ones decoded.
    ``positions`` adds ``row_idx``, the row's place in its split. It follows
    from the recorded row counts, so nothing is shuffled.
    """
    _register(spark)
    _require(path, split)
    reader = _source(spark, path, split)
    if columns is not None:
        reader = reader.option("columns", json.dumps(list(columns)))
    if positions:
        reader = reader.option("positions", "true")
    return reader.load()


def load(spark: SparkSession, path: str | None = None, split: str | None = None, mode: str = "row"):
    """A dataset and, in ``file`` mode, the digests of its files.

    In ``row`` mode nothing is hashed at load: rows are measured when read, by
    a multiset digest, and the manifest is ``None``.
    """
    if path is None:
        raise ValueError("a dataset path is needed")
    if mode not in ("row", "file"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "file":
        return read_dataset(spark, path, split), file_manifest(spark, path, split)
    try:
        return read_dataset(spark, path, split), None
    except ValueError as missing:
        raise FileNotFoundError(f"split {split!r} not found in {path}") from missing
