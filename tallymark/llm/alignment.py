"""Alignment of the tokens of two tokenizers through an inverted index of bitmaps.

Both tokenizers cut the same bytes. Where tokens of both end at one byte the
text is cut into groups, and all token pairs of a group are linked. The index
holds, for each pair of ids, in which documents it is linked: tasks number
their documents in blocks, the bitmaps of a block's batches are merged by OR,
and a block's bitmap of a pair is stored as bit planes of the pair's
multiplicity in each document. The OR of the planes has one bit for every
document, so its population count is the block's document count; the counts of
the planes, weighed by powers of two, add up to the links. Blocks hold
different documents, so a pair's counts over the corpus are sums over blocks,
added before and after a shuffle.

Scores return along the postings: the bitmaps meet the counts of their pair,
go back to their block, and every set bit adds the pair's count to its
document. What travels is bounded by the bitmaps, never a row for each link,
and no pair gathers its documents in one task.

A bitmap is a sorted list of 16-bit places, or the plain bits where those are
shorter; lists have an even number of bytes, plain bits an odd one.

Nulls, ties and odd rows: null and empty texts, and texts whose joined tokens
are not the text, have zeros and the digest ``''``. Rows of one ``doc_id``, with
or without equal texts, and rows without one are documents like any other. Ids
with equal counts are all best. A group of any size is linked whole: large ones
by the distinct ids on either side. A block is closed after ``POSTINGS``
postings, and one document's postings are held together. Columns other than
``doc_id`` and ``text`` are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm import bpe
from tallymark.llm.batches import small_batches
from tallymark.llm.shipping import ship
from tallymark.session import materialise

#: Postings and documents of a block, characters aligned together, links of a group listed one by one.
POSTINGS, PLACES, GROUP_CHARS, LISTED = 4_000_000, 1 << 16, 1 << 20, 1 << 16
#: Bits of an id in a packed pair.
ID_BITS = 20
_LONG = re.compile(r"\S{2000}|\s{2000}")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
# Fixed value: the public pattern of the byte-level split.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """The two tokenizers, and the bytes of each of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken

        self.vocabulary = bpe.Vocabulary(byte_path)
        self.byte_level = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=self.vocabulary.ids, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        one = lambda p: bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode()
        self.a_bytes = [b""] * (1 + max(self.vocabulary.ids.values()))
        for token, i in self.vocabulary.ids.items():
            self.a_bytes[i] = token
        self.b_bytes = [one(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())]
        self.a_size = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)

    def byte_ids(self, text: str) -> list[int]:
        """Ids of the byte-level vocabulary; words too long for its library are merged here."""
        if _LONG.search(text):
            return [i for w in bpe.words(text) for i in self.vocabulary.merge(w.encode())]
        return self.byte_level.encode_ordinary(text)

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by both; none where the joined tokens are not a space and the text."""
        given = [t or "" for t in texts]
        right = self.pieces.encode(given, num_threads=1) if given else []
        left, table = [], self.b_bytes
        for i, text in enumerate(given):
            whole = f" {text}".encode()
            ids = self.byte_ids(f" {text}") if text and b"".join(map(table.__getitem__, right[i])) == whole else []
            if sum(map(len, map(self.a_bytes.__getitem__, ids))) != len(whole):
                ids = []
            left.append(ids)
            right[i] = right[i] if ids else []
        return left, right


@lru_cache(1)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids below ``n`` as decimal text with ``,``, ``|`` or ``;`` behind, padded by zero bytes, and their lengths."""
    made = [f"{i}{s}".encode() for i in range(n) for s in ",|;"]
    width = max(map(len, made))
    return np.frombuffer(np.array(made, f"S{width}").tobytes(), np.uint8).reshape(-1, width), np.array([len(m) for m in made], np.int64)


def align_texts(tokenizers: Tokenizers, texts: list[str | None]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """Counts and digest of each text, and its linked pairs.

    The pairs come as sorted distinct ``pair << 16 | text`` numbers with their
    multiplicities; there are at most 65,536 texts.
    """
    left, right = tokenizers.encode(texts)
    n = len(texts)
    n_a, n_b = (np.fromiter(map(len, ids), np.int64, n) for ids in (left, right))
    a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum())) for ids, size in ((left, n_a), (right, n_b)))
    end_a, end_b = np.cumsum(tokenizers.a_size[a]), np.cumsum(tokenizers.b_size[b])
    both = np.zeros(1 + (int(end_a[-1]) if len(a) else 0), np.int64)
    both[end_b] = 1
    mark = np.zeros_like(both)
    mark[end_a] = 1
    both &= mark
    before = np.cumsum(both) - both
    of_a, of_b, groups = before[end_a], before[end_b], int(both.sum())
    count_a, count_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
    first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    text_a = np.repeat(np.arange(n), n_a)
    text_g = text_a[first_a] if groups else np.zeros(0, np.int64)
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, text_g, count_a * count_b)
    facts = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(text_g, minlength=n), "n_links": n_links,
             "groups_sha256": _group_digests(n_a, n_b, a, b, of_a, of_b, count_a, first_a, first_b)}
    large = count_a * count_b > LISTED
    times = np.where(large, 0, count_b)[of_a]
    step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    pair = (np.repeat(a, times) << ID_BITS) | b[np.repeat(first_b[of_a], times) + step]
    keys, counts = np.unique((pair << 16) | np.repeat(text_a, times), return_counts=True)
    if large.any():
        keys, counts = [keys], [counts]
        for g in np.flatnonzero(large).tolist():
            x, times_x = np.unique(a[first_a[g]:first_a[g] + count_a[g]], return_counts=True)
            y, times_y = np.unique(b[first_b[g]:first_b[g] + count_b[g]], return_counts=True)
            keys.append(((((x[:, None] << ID_BITS) | y[None, :]) << 16) | text_g[g]).ravel())
            counts.append((times_x[:, None] * times_y[None, :]).ravel())
        keys, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, np.concatenate(counts))
        counts = total
    return facts, keys, counts.astype(np.int64)


def _group_digests(n_a, n_b, a, b, of_a, of_b, count_a, first_a, first_b) -> list[str]:
    """Digest of the groups' ids as text, ``''`` for a text without tokens."""
    last_a = np.diff(of_a, append=-1) != 0
    last_b = np.diff(of_b, append=-1) != 0
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + first_b[of_a]] = a * 3 + last_a
    code[np.arange(len(b)) + first_a[of_b] + count_a[of_b]] = b * 3 + 2 * last_b
    table, sizes = _digits(1 << max(16, int(code.max() // 3).bit_length()) if len(code) else 1 << 16)
    flat = table[code].ravel()
    data = flat[flat != 0].tobytes()
    end = np.concatenate(([0], np.cumsum(sizes[code])))
    cut = np.concatenate(([0], np.cumsum(n_a + n_b)))
    edges = end[cut].tolist()
    return [hashlib.sha256(data[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(edges[:-1], edges[1:])]


# --- bitmaps ------------------------------------------------------------------------------------


def planes_of(pair: np.ndarray, place: np.ndarray, count: np.ndarray, places: int) -> tuple[np.ndarray, list[list[bytes]]]:
    """First posting of every pair, and its bitmaps for each bit of the multiplicities.

    Postings are sorted by pair and place; ``places`` is the number of places.
    """
    start = np.flatnonzero(np.diff(pair, prepend=-1))
    bits = max(1, int(count.max()).bit_length()) if len(count) else 1
    owner = np.cumsum(np.diff(pair, prepend=-1) != 0) - 1
    chosen = [np.flatnonzero((count >> j) & 1) for j in range(bits)]
    slot = np.concatenate([owner[c] * bits + j for j, c in enumerate(chosen)])
    order = np.argsort(slot, kind="stable")
    slot, at = slot[order], place[np.concatenate(chosen)][order].astype("<u2")
    edge = np.flatnonzero(np.diff(slot, prepend=-1, append=-1))
    data, plain = at.tobytes(), (places + 7) // 8 | 1
    out: list[list[bytes]] = [[] for _ in range(len(start))]
    for s, e, (pair_at, bit) in zip(edge[:-1].tolist(), edge[1:].tolist(), zip(*(x.tolist() for x in np.divmod(slot[edge[:-1]], bits)))):
        if 2 * (e - s) < plain:
            one = data[2 * s:2 * e]
        else:
            row = np.zeros(plain * 8, bool)
            row[at[s:e]] = True
            one = np.packbits(row, bitorder="little").tobytes()
        planes = out[pair_at]
        planes.extend([b""] * (bit - len(planes)))
        planes.append(one)
    return start, out


def places_of(column: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set places of a binary column's bitmaps, and for each the weight of its bitmap."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    size = np.diff(offsets)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    listed = size % 2 == 0
    place = [data[np.repeat(listed, size)].view("<u2").astype(np.int64)]
    weights = [np.repeat(weight[listed], size[listed] // 2)]
    for i in np.flatnonzero(~listed).tolist():
        row = data[offsets[i] - offsets[0]:offsets[i + 1] - offsets[0]]
        place.append(np.flatnonzero(np.unpackbits(row, bitorder="little")))
        weights.append(np.full(len(place[-1]), weight[i]))
    return np.concatenate(place), np.concatenate(weights)


# --- on Spark -----------------------------------------------------------------------------------


_FACTS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_TYPES = {"block": pa.int64(), "place": pa.int32(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
          "groups_sha256": pa.string(), "a": pa.int32(), "b": pa.int32(), "docs": pa.int64(), "links": pa.int64(), "planes": pa.list_(pa.binary())}


def index(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row for every document and one for every pair of a block, written once.

    Documents have ``block, place, doc_id`` and their counts; pairs (where ``a``
    is not null) have ``block, a, b, docs, links, planes``.
    """
    spark = docs.sparkSession
    byte_file, piece_file = (ship(spark, name, open(path, "rb").read()) for name, path in (("bytes", byte_path), ("pieces", piece_path)))
    schema = (f"block bigint, place int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, "
              "n_links bigint, groups_sha256 string, a int, b int, docs bigint, links bigint, planes array<binary>")

    def rows(kind: pa.DataType, n: int, **columns) -> pa.RecordBatch:
        types = {k: t for k, t in _TYPES.items() if k in ("block", "place")} | {"doc_id": kind} | {k: t for k, t in _TYPES.items() if k not in ("block", "place")}
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in types.items()], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]):
        tokenizers = Tokenizers(SparkFiles.get(byte_file), SparkFiles.get(piece_file))
        task, blocks = TaskContext.get().partitionId(), 0
        held, keys, counts, n, size = [], [], [], 0, 0

        def close(kind: pa.DataType):
            block = (task << 32) | blocks
            ids = pa.concat_arrays([h[0] for h in held])
            facts = {k: pa.array(list(chain.from_iterable(h[1][k] for h in held)), _TYPES[k]) for k in _FACTS}
            yield rows(kind, n, block=pa.array(np.full(n, block), pa.int64()), place=pa.array(np.arange(n), pa.int32()), doc_id=ids, **facts)
            key, count = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            start, planes = planes_of(key >> 16, key & 0xFFFF, count, n)
            pair = key[start] >> 16
            found = np.diff(start, append=len(key))
            links = np.add.reduceat(count, start) if len(start) else count
            for at in range(0, len(start), 50_000):
                cut = slice(at, at + 50_000)
                m = len(pair[cut])
                yield rows(kind, m, block=pa.array(np.full(m, block), pa.int64()), a=pa.array(pair[cut] >> ID_BITS, pa.int32()),
                           b=pa.array(pair[cut] & ((1 << ID_BITS) - 1), pa.int32()), docs=pa.array(found[cut], pa.int64()),
                           links=pa.array(links[cut], pa.int64()), planes=pa.array(planes[cut], pa.list_(pa.binary())))

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and chars < GROUP_CHARS and n + end - at < PLACES:
                    chars += len(texts[end] or "")
                    end += 1
                facts, key, count = align_texts(tokenizers, texts[at:end])
                held.append((ids.slice(at, end - at), facts))
                keys.append(key + n)
                counts.append(count)
                n, size, at = n + end - at, size + len(key), end
                if size >= POSTINGS or n >= PLACES:
                    yield from close(ids.type)
                    held, keys, counts, n, size, blocks = [], [], [], 0, 0, blocks + 1
        if n:
            yield from close(held[0][0].type)

    return materialise(small_batches(docs).select("doc_id", "text").mapInArrow(run, schema))


def pair_counts(parts: DataFrame) -> DataFrame:
    """``a, b, docs, links, best`` of every linked pair of ids; ``best`` marks the most documents of its ``a``."""
    pairs = materialise(parts.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")))
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    # at most one row for each id of the vocabulary
    return pairs.join(F.broadcast(most), "a").select("a", "b", "docs", "links", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Links of every document and their scores by the index of the whole corpus.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``.
    """
    parts = index(docs, byte_path or bpe.public_vocabulary(), piece_path or bpe.public_vocabulary("piece_bpe_32k.model"))
    scored = (parts.where("a IS NOT NULL").select("block", "a", "b", "planes")
              .join(pair_counts(parts).select("a", "b", "docs", "best"), ["a", "b"])
              .select(F.col("block").alias("of_block"), "docs", "best", "planes"))
    found = parts.where("a IS NULL").select("block", "place", "doc_id", *_FACTS)
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(texts: pa.Table, postings: pa.Table) -> pa.Table:
        n = texts.num_rows
        place = texts["place"].to_numpy()
        best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in postings.to_batches():
            planes = batch.column("planes")
            count = np.diff(np.asarray(planes.offsets))
            bit = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            for name, sums in (("docs", total), ("best", best)):
                weight = np.repeat(batch.column(name).cast(pa.int64()).to_numpy(), count) << bit
                np.add.at(sums, *places_of(planes.flatten(), weight))
        out = texts.drop_columns(["block", "place"]).append_column("n_best", pa.array(best[place])).append_column("count_sum", pa.array(total[place]))
        return out.select(order)

    types = dict(found.dtypes) | {"n_best": "bigint", "count_sum": "bigint"}
    return found.groupBy("block").cogroup(scored.groupBy("of_block")).applyInArrow(run, ", ".join(f"{c} {types[c]}" for c in order))
