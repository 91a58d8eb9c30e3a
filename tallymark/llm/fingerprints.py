"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines with their line feeds; a line is cut further
behind words whose hash says so, so an edit changes only the pieces around it.
A digest is of a piece's exact bytes, letter case and white space with them,
and of how often the piece occurred before, so repeats count. The set of their
digests is kept in a sketch of cells (count, sum of digests, sum of check
values), each digest in three cells. Two sketches of one size subtract cell by
cell; what both texts hold cancels out, and peeling cells that hold a single
digest recovers the differing ones. When peeling stalls, both versions are
sketched again with four times the cells, until it ends.

Finding each document's successor needs the documents in id order: they are
shuffled once into runs of ids, and the first document of each run is also sent
to the run before. A task streams its sorted run with one document looked
ahead; a batch of pairs is subtracted and peeled together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.hashing import mix, span_hashes, word_spans

#: Cells of a fingerprint; a multiple of 3. A stalled comparison goes on with ``GROW`` times the cells.
CELLS, GROW = 24, 4
#: A line is cut behind a word whose hash is a multiple of this.
PIECE = 8
#: Characters of text compared together.
GROUP_CHARS = 1 << 21


def pieces(data: np.ndarray) -> np.ndarray:
    """Sorted digests of the paragraphs of a text given as UTF-8 bytes; none of an empty text.

    Equal pieces are told apart by their number of earlier occurrences, so
    texts with one set of digests have the same pieces, each as often.
    """
    if not len(data):
        return np.zeros(0, np.uint64)
    words, _, end = word_spans(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[end[words % np.uint64(PIECE) == 0]] = True
    cut[0] = cut[-1] = True
    at = np.flatnonzero(cut)
    keys = np.sort(span_hashes(data, at[:-1], at[1:]))
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    place = np.arange(len(keys))
    earlier = place - np.maximum.accumulate(np.where(first, place, 0))
    return np.unique(mix(keys + mix(earlier.astype(np.uint64))))


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of every key, one in each third; the size seeds the hashes."""
    third = np.uint64(cells // 3)
    salt = np.uint64(cells * 0x9E3779B9 % 2**63)
    return np.stack([mix(keys ^ mix(np.array([salt + np.uint64(j)]))) % third + np.uint64(j) * third for j in range(3)]).astype(np.int64)


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys + np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(keys: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums of keys and sums of check values of the cells (64-bit, wrapping)."""
    at = _places(keys, cells).ravel()
    count = np.bincount(at, minlength=cells).astype(np.int64)
    total, check = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
    np.add.at(total, at, np.tile(keys, 3))
    np.add.at(check, at, np.tile(_check(keys), 3))
    return count, total, check


def to_text(keys: np.ndarray) -> str:
    """The fingerprint of a set of digests: its sketch of ``CELLS`` cells in base64."""
    count, total, check = sketch(keys)
    return base64.b64encode(count.astype("<i4").tobytes() + total.astype("<u8").tobytes() + check.astype("<u8").astype("<u4").tobytes()).decode()


def peel(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Digests that only the first and only the second set of each pair holds.

    All pairs are sketched with ``cells`` cells, subtracted and peeled together;
    None where peeling stalled.
    """
    n = len(pairs)
    left, right = np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])
    keys = np.concatenate([left, right])
    owner = np.concatenate([np.repeat(np.arange(n), [len(a) for a, _ in pairs]), np.repeat(np.arange(n), [len(b) for _, b in pairs])])
    sign = np.concatenate([np.ones(len(left), np.int64), -np.ones(len(right), np.int64)])
    count, total, check = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)

    def add(keys, owner, sign):
        at = (_places(keys, cells) + owner * cells).ravel()
        signed = np.tile(sign.astype(np.uint64), 3)
        np.add.at(count, at, np.tile(sign, 3))
        np.add.at(total, at, np.tile(keys, 3) * signed)
        np.add.at(check, at, np.tile(_check(keys), 3) * signed)

    add(keys, owner, sign)
    found_keys, found_owner, found_sign = [], [], []
    while True:
        lone = np.flatnonzero(np.abs(count) == 1)
        side = count[lone]
        key = total[lone] * side.astype(np.uint64)
        pure = _check(key) * side.astype(np.uint64) == check[lone]
        lone, side, key = lone[pure], side[pure], key[pure]
        if not len(lone):
            break
        who = lone // cells
        order = np.lexsort((key, who))
        who, key, side = who[order], key[order], side[order]
        once = np.concatenate(([True], (who[1:] != who[:-1]) | (key[1:] != key[:-1])))
        who, key, side = who[once], key[once], side[once]
        found_keys.append(key), found_owner.append(who), found_sign.append(side)
        add(key, who, -side)
    stalled = ((count != 0) | (total != 0) | (check != 0)).reshape(n, cells).any(axis=1)
    key = np.concatenate(found_keys) if found_keys else np.zeros(0, np.uint64)
    who = np.concatenate(found_owner) if found_owner else np.zeros(0, np.int64)
    side = np.concatenate(found_sign) if found_sign else np.zeros(0, np.int64)
    order = np.argsort(who, kind="stable")
    key, who, side = key[order], who[order], side[order]
    cut = np.searchsorted(who, np.arange(n + 1))
    out: list[tuple[np.ndarray, np.ndarray] | None] = []
    for i in range(n):
        mine, s = key[cut[i]:cut[i + 1]], side[cut[i]:cut[i + 1]]
        out.append(None if stalled[i] else (mine[s > 0], mine[s < 0]))
    return out


def differences(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Differing digests of each pair, retrying with larger sketches where peeling stalls."""
    out: list = [None] * len(pairs)
    open_pairs, cells = list(range(len(pairs))), CELLS
    while open_pairs:
        for i, found in zip(open_pairs, peel([pairs[i] for i in open_pairs], cells)):
            out[i] = found
        open_pairs = [i for i in open_pairs if out[i] is None]
        cells *= GROW
        if cells > 1 << 40:
            raise ValueError("equal digests within one set")
    return out


def likeness(pair: tuple[np.ndarray, np.ndarray], difference: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the digests of both versions that both hold; 1 for two empty ones."""
    size = len(pair[0]) + len(pair[1])
    return 1.0 - (len(difference[0]) + len(difference[1])) / size if size else 1.0


def with_successor(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``doc_id, text, guest`` sorted within partitions so that a row's successor follows it.

    Order is by ``doc_id`` (null first), then by text hash. Every partition
    ends with a guest, the first row of the next one; behind the last row of
    all comes the first.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    ids = rows.where("doc_id is not null").select(F.col("doc_id").cast("double"))
    found = ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    cuts = np.array(sorted({int(x) for x in found}), np.int64)

    @F.pandas_udf("int")
    def run_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.fillna(-2**63).astype("int64").to_numpy()
        return pd.Series(np.searchsorted(cuts, known, "right").astype("int32"))

    firsts = (keyed.select(run_of(F.col("doc_id")).alias("run"), F.struct("doc_id", "hash").alias("key"))
              .groupBy("run").agg(F.min("key").alias("key")).orderBy("run").collect())  # one row per partition
    before = {r.run: firsts[i - 1].run for i, r in enumerate(firsts)}
    guests = spark.createDataFrame([(r.run, r.key.doc_id, r.key.hash, before[r.run]) for r in firsts],
                                   "run int, first_id bigint, first_hash bigint, also int")
    tagged = (keyed.withColumn("run", run_of(F.col("doc_id"))).join(F.broadcast(guests), "run", "left"))  # one row per partition
    lead = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    own, other = F.struct("run", F.lit(0).alias("guest")), F.struct(F.col("also").alias("run"), F.lit(1).alias("guest"))
    dealt = tagged.select("doc_id", "text", "hash", F.explode(F.when(lead, F.array(own, other)).otherwise(F.array(own))).alias("to"))
    return (dealt.select("doc_id", "text", "hash", "to.run", "to.guest").repartitionById(len(cuts) + 1, F.col("run"))
            .sortWithinPartitions("guest", "doc_id", "hash").select("doc_id", "text", "guest"))


def compare_with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text replaces the last half of the code points by as many of the
    successor's first ones. Gives ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, added, removed``:
    the last two count the digests that the edit added and removed. A null text
    counts as empty; a lone document is its own successor; repeated ids follow
    each other.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "added", "removed"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def compared(rows: list[tuple], following: tuple) -> pa.RecordBatch:
        sets = [pieces(np.frombuffer(t.encode(), np.uint8)) for _, t in [*rows, following]]
        texts = [t for _, t in [*rows, following]]
        edited = [t[:len(t) - len(t) // 2] + texts[i + 1][:len(t) // 2] for i, t in enumerate(texts[:-1])]
        edited_sets = [pieces(np.frombuffer(t.encode(), np.uint8)) for t in edited]
        with_edit = list(zip(sets[:-1], edited_sets))
        with_next = list(zip(sets[:-1], sets[1:]))
        changed, apart = differences(with_edit), differences(with_next)
        columns = [[d for d, _ in rows], [len(t) for _, t in rows], [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                   [to_text(s) for s in sets[:-1]], [to_text(s) for s in edited_sets],
                   [likeness(p, d) for p, d in zip(with_edit, changed)], [likeness(p, d) for p, d in zip(with_next, apart)],
                   [len(b) for _, b in changed], [len(a) for a, _ in changed]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]):
        rows, size, guest = [], 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for row in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "guest"))):
                    if row[2]:
                        guest = guest or row[:2]
                        continue
                    if size > GROUP_CHARS:
                        yield compared(rows, row[:2])
                        rows, size = [], 0
                    rows.append(row[:2])
                    size += len(row[1])
        if rows:
            yield compared(rows, guest)

    return with_successor(docs, parts).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, added bigint, removed bigint")
