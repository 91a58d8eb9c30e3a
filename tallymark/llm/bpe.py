"""Byte-pair encoding and decoding with a minimal acyclic transducer lexicon.

The corpus' frequent words are merged once and compiled into a minimal acyclic
automaton: words with common endings share their states, and the numbers on a
path's edges add up to the word's rank, which points at its ids. The automaton
is a flat file that every executor maps into memory, so its Python workers
share one copy. Whole batches of words walk it together, one byte a step.
Words that it does not hold are merged by the vocabulary's own rules, so the
lexicon changes how fast a text is encoded and never what the ids are.

Encoding and decoding need no shuffle; only the word counts are shuffled.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tallymark.llm.batches import small_batches
from tallymark.llm.hashing import mix
from tallymark.llm.shipping import ship
from tallymark.session import materialise

#: Words of the lexicon at most, and the longest one in bytes; others are merged where they occur.
LEXICON_WORDS = 200_000
LEXICON_BYTES = 24
#: Encoded words a worker remembers before it starts afresh.
CACHE_WORDS = 150_000
#: Characters whose words are looked up together.
GROUP_CHARS = 1 << 20
#: Bits of an id in a packed number.
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
#: A pair that does not merge; longest word in bytes, and words, that are merged together.
NONE, WIDE, TOGETHER = 1 << 60, 40, 8192

# White space of the byte-level split, and letters and numbers of
# Unicode 16 that older Unicode tables lack.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
               (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
               (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
               (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
               (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
               (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@lru_cache(None)
def _splitter(top: int) -> re.Pattern:
    """The byte-level split of a text whose code points do not pass ``top``."""

    def chars(major: str, extra: list[tuple[int, int]]) -> str:
        inside = [unicodedata.category(chr(c))[0] == major for c in range(top + 1)]
        for a, b in extra:
            inside[a:b + 1] = [True] * len(inside[a:b + 1])
        edges = [c for c in range(top + 2) if (c <= top and inside[c]) != (c > 0 and inside[c - 1])]
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[0::2], edges[1::2]))

    letter, number = chars("L", NEW_LETTERS), chars("N", NEW_NUMBERS)
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+"
                      f"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def words(text: str) -> list[str]:
    """The text cut into the words that are merged one by one; they join to the text."""
    wide = not text.isascii() and max(text) > "\uffff"
    return _splitter(0x10FFFF if wide else 0xFFFF).findall(text)


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A saved byte-level BPE vocabulary: ids, merge ranks, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            saved = json.load(file)
        model, symbols = saved["model"], byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        # (left id, right id) -> rank and merged id, each in one number
        self.pairs = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            self.pairs[self.ids[left] << ID_BITS | self.ids[right]] = rank << ID_BITS | self.ids[left + right]
        self.single = [self.ids.get(bytes([b])) for b in range(256)]
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        by = np.argsort(keys)
        self.keys, self.merged = keys[by], np.fromiter(self.pairs.values(), np.int64, len(self.pairs))[by]
        self.added = {t["content"]: t["id"] for t in saved["added_tokens"]}
        self.pieces = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the lowest-ranked neighbouring pair merges first, the leftmost of equals."""
        parts = [self.single[b] for b in word]
        if len(parts) > 256:
            return self._merge_long(parts)
        known, none = self.pairs.get, NONE
        pairs = [known(a << ID_BITS | b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [best & ID_MASK]
            del pairs[i]
            if i:
                pairs[i - 1] = known(parts[i - 1] << ID_BITS | parts[i], none)
            if i < len(pairs):
                pairs[i] = known(parts[i] << ID_BITS | parts[i + 1], none)
        return parts

    def _pairs_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Packed rank and merged id of neighbours, ``NONE`` where they do not merge."""
        key = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where((right >= 0) & (self.keys[at] == key), self.merged[at], NONE) if len(self.keys) else np.full(left.shape, NONE)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """The same for many words; a step merges one pair in each, so short words cost little."""
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= WIDE]
        for i, w in enumerate(words):
            if not 0 < len(w) <= WIDE:
                out[i] = self.merge(w)
        # words of like length together
        short.sort(key=lambda i: len(words[i]))
        for at in range(0, len(short), TOGETHER):
            rows = np.array(short[at:at + TOGETHER])
            size = np.array([len(words[i]) for i in rows.tolist()])
            there = np.arange(size.max()) < size[:, None]
            ids = np.full(there.shape, -1, np.int64)
            ids[there] = np.array(self.single)[np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8)]
            pairs = self._pairs_of(ids[:, :-1], ids[:, 1:])
            while len(rows):
                place = pairs.argmin(1) if pairs.shape[1] else np.zeros(len(rows), np.int64)
                best = pairs[np.arange(len(rows)), place] if pairs.shape[1] else np.full(len(rows), NONE)
                done = best == NONE
                for i, parts in zip(rows[done].tolist(), ids[done].tolist()):
                    out[i] = parts[:parts.index(-1)] if parts[-1] < 0 else parts
                rows, ids, pairs, place, best = (x[~done] for x in (rows, ids, pairs, place, best))
                every = np.arange(len(rows))
                ids[every, place] = best & ID_MASK
                column = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, column + (column > place[:, None]), 1)
                column = column[:-1]
                pairs = np.take_along_axis(pairs, column + (column >= place[:, None]), 1)
                for inside, left in ((place > 0, place - 1), (place < pairs.shape[1], place)):
                    r, c = every[inside], left[inside]
                    pairs[r, c] = self._pairs_of(ids[r, c], ids[r, c + 1])
        return out

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        import heapq

        n, known = len(parts), self.pairs.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(pair, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (pair := known(a << ID_BITS | b)) is not None]
        heapq.heapify(heap)
        while heap:
            pair, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # one of the two has merged since
            parts[i], parts[j], after[i] = pair & ID_MASK, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (pair := known(parts[x] << ID_BITS | parts[y])) is not None:
                    heapq.heappush(heap, (pair, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]


# --- the transducer -----------------------------------------------------------------------------


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """Compile ``word, ids`` entries into the file that :class:`Lexicon` maps.

    Words are distinct, hold no zero byte and at most ``LEXICON_BYTES`` bytes.
    Trie states are built level by level from the sorted words; states with
    equal sets of endings (compared by a 64-bit hash) become one.
    """
    entries = sorted(entries)
    n, width = len(entries), max([1, *(len(w) for w, _ in entries)])
    table = np.frombuffer(np.array([w for w, _ in entries], f"S{width}").tobytes(), np.uint8).reshape(n, width) if n else np.zeros((0, 1), np.uint8)
    length = np.array([len(w) for w, _ in entries], np.int64)
    levels = []  # per depth: first row of each state, state of the parent, byte that leads to it
    changed, parent_of_row = np.zeros(n, bool), np.zeros(n, np.int64)
    if n:
        changed[0] = True
    levels.append((np.zeros(min(n, 1), np.int64), None, None))
    for depth in range(1, width + 1):
        differs = np.concatenate(([True], table[1:, depth - 1] != table[:-1, depth - 1])) if n else np.zeros(0, bool)
        changed = changed | differs
        there = length >= depth
        # the first row of a state follows a different prefix or a shorter word
        first = there & (changed | np.concatenate(([True], ~there[:-1]))) if n else there
        rows = np.flatnonzero(first)
        levels.append((rows, parent_of_row[rows], table[rows, depth - 1]))
        parent_of_row = np.cumsum(first) - 1
    hashes, counts, finals = [None] * (width + 1), [None] * (width + 1), [None] * (width + 1)
    for depth in range(width, -1, -1):
        rows = levels[depth][0]
        final = length[rows] == depth
        total = mix(final.astype(np.uint64) + np.uint64(17))
        count = final.astype(np.int64)
        if depth < width and len(levels[depth + 1][0]):
            _, parent, byte = levels[depth + 1]
            np.add.at(total, parent, mix(hashes[depth + 1] + mix(byte.astype(np.uint64) + np.uint64(1000))))
            np.add.at(count, parent, counts[depth + 1])
        hashes[depth], counts[depth], finals[depth] = mix(total), count, final
    every = np.concatenate(hashes)
    _, sample, state = np.unique(every, return_index=True, return_inverse=True)
    start = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
    kept = np.zeros(len(every), bool)
    kept[sample] = True
    keys, targets, outputs = [], [], []
    for depth in range(width):
        _, parent, byte = levels[depth + 1]
        if not len(byte):
            continue
        below = counts[depth + 1]
        running = np.cumsum(below) - below
        first = np.concatenate(([True], parent[1:] != parent[:-1]))
        output = running - running[first][np.cumsum(first) - 1] + finals[depth][parent]
        use = kept[start[depth] + parent]
        keys.append(state[start[depth] + parent][use] * 256 + byte[use])
        targets.append(state[start[depth + 1] + np.arange(len(byte))][use])
        outputs.append(output[use])
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    keys, targets, outputs = join(keys), join(targets), join(outputs)
    order = np.argsort(keys)
    final = np.concatenate(finals)[sample] if n else np.zeros(1, bool)
    offsets = np.concatenate(([0], np.cumsum([len(ids) for _, ids in entries]))).astype(np.int64)
    flat = np.array([i for _, ids in entries for i in ids], np.int64)
    root = np.array([state[0] if n else 0], np.int64)
    arrays = [root, keys[order], targets[order], outputs[order], final.astype(np.int64), offsets, flat]
    out = io.BytesIO()
    out.write(struct.pack("<7q", *(len(a) for a in arrays)))
    for a in arrays:
        out.write(a.astype("<i8").tobytes())
    return out.getvalue()


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        whole = np.memmap(path, "<i8", "r")
        at, parts = 7, []
        for size in whole[:7].tolist():
            parts.append(whole[at:at + size])
            at += size
        root, self.keys, self.targets, self.outputs, self.final, self.offsets, self.ids = parts
        self.root = int(root[0])

    @property
    def states(self) -> int:
        return len(self.final)

    def ranks(self, found: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 where the lexicon does not hold it."""
        n = len(found)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        length = np.fromiter(map(len, found), np.int64, n)
        flat = np.frombuffer(b"".join(found), np.uint8)
        start = np.cumsum(length) - length
        live = np.flatnonzero((length > 0) & (length <= LEXICON_BYTES))
        state, rank = np.full(len(live), self.root), np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            done = length[live] == depth
            end = live[done]
            out[end] = np.where(self.final[state[done]] == 1, rank[done], -1)
            live, state, rank = live[~done], state[~done], rank[~done]
            key = state * 256 + flat[start[live] + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            live, state, rank = live[hit], self.targets[edge[hit]], rank[hit] + self.outputs[edge[hit]]
            depth += 1
        return out

    def ids_of(self, ranks: np.ndarray) -> Iterator[list[int]]:
        """Ids of the words of these ranks."""
        start, end = self.offsets[ranks], self.offsets[ranks + 1]
        size = end - start
        edge = np.cumsum(size)
        flat = np.asarray(self.ids)[np.arange(int(size.sum())) + np.repeat(start - edge + size, size)].tolist()
        for a, b in zip((edge - size).tolist(), edge.tolist()):
            yield flat[a:b]


class Coder:
    """Encodes and decodes texts with one vocabulary and lexicon."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.text_of: dict[str, str] = {}  # word -> ids as decimal text, each with a comma behind
        self.bytes_of: dict[str, bytes] = {}  # word -> bytes its ids decode to

    def learn(self, missing: set[str], needed: set[str]) -> None:
        """Remember the ids of the missing words; ``needed`` are all that must be known afterwards."""
        if len(self.text_of) + len(missing) > CACHE_WORDS:
            for known in (self.text_of, self.bytes_of):  # the older half goes
                for word in list(islice(known, (len(known) + 1) // 2)):
                    del known[word]
            missing = needed - self.text_of.keys()
            if len(self.text_of) + len(missing) > CACHE_WORDS:
                self.text_of.clear()
                self.bytes_of.clear()
                missing = needed
        raw = [w.encode() for w in missing]
        ranks = self.lexicon.ranks(raw) if self.lexicon else np.full(len(raw), -1)
        stored = self.lexicon.ids_of(ranks[ranks >= 0]) if self.lexicon else iter(())
        pieces, added = self.vocabulary.pieces, self.vocabulary.added
        merged = iter(self.vocabulary.merge_many([data for data, rank in zip(raw, ranks.tolist()) if rank < 0]))
        for word, rank in zip(missing, ranks.tolist()):
            ids = next(stored) if rank >= 0 else next(merged)
            ids = [added[word]] if word in added else ids
            self.text_of[word] = "".join([f"{i}," for i in ids])
            self.bytes_of[word] = b"".join([pieces[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """Words and added tokens of a text."""
        pattern = self.vocabulary.added_pattern
        if pattern is None or not any(t in text for t in self.vocabulary.added):
            return words(text)
        return [w for i, part in enumerate(pattern.split(text)) for w in ([part] if i % 2 else words(part))]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """Ids of each text as decimal text joined by commas, and the text they decode to.

        Words are looked up for about ``GROUP_CHARS`` characters at a time.
        """
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < GROUP_CHARS:
                size += len(texts[end] or "")
                end += 1
            found = [self.split(text or "") for text in texts[at:end]]
            every = set().union(*found)
            missing = every - self.text_of.keys()
            if missing:
                self.learn(missing, every)
            for one in found:
                ids = "".join(map(self.text_of.__getitem__, one))
                yield ids[:-1], b"".join(map(self.bytes_of.__getitem__, one)).decode("utf-8", "replace")
            at = end

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; bytes that are no UTF-8 become replacement characters."""
        pieces = self.vocabulary.pieces
        return b"".join([pieces[i] for i in ids if i in pieces]).decode("utf-8", "replace")


# --- on Spark -----------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of all texts; each task adds up its words before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update(words(text))
                    if len(counts) > CACHE_WORDS:
                        often = {w: n for w, n in counts.items() if n > 1}
                        if len(often) > CACHE_WORDS // 2:
                            often = {}
                        for word in often:  # counted on
                            del counts[word]
                        yield out()
                        counts = Counter(often)
        yield out()

    return small_batches(docs).select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """The words above the lowest count step that leaves at most ``most`` of them.

    A step is an eighth of a power of two, so the histogram that goes to the
    driver has at most 512 rows.
    """
    counted = word_counts(docs).where((F.octet_length("word") <= LEXICON_BYTES) & ~F.contains("word", F.lit("\0")) & (F.col("n") > 1))
    counted = materialise(counted.withColumn("step", F.floor(8 * F.log2("n")).cast("int")))
    total, least = 0, None
    for step, n in sorted(counted.groupBy("step").count().collect(), reverse=True):
        if total + n > most:
            break
        total, least = total + n, step
    return counted.where(F.col("step") >= least if least is not None else F.lit(False)).select("word")


def build_lexicon(docs: DataFrame, vocabulary_path: str, most: int = LEXICON_WORDS) -> bytes:
    """Merge the corpus' frequent words on the executors and compile them on the driver.

    The driver receives at most ``most`` words of ``LEXICON_BYTES`` bytes.
    """
    shared = ship(docs.sparkSession, "vocabulary", open(vocabulary_path, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(SparkFiles.get(shared))
            found = [w.encode() for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(vocabulary.merge_many(found), pa.list_(pa.int64()))],
                                             names=["word", "ids"])

    made = frequent_words(docs, most).mapInArrow(run, "word binary, ids array<bigint>").toArrow()
    return compile_lexicon(list(zip(made["word"].to_pylist(), made["ids"].to_pylist())))


def code(docs: DataFrame, vocabulary_path: str, keep: tuple[str, ...] = (), outputs: tuple[str, ...] = ("ids", "decoded"),
         most: int = LEXICON_WORDS) -> DataFrame:
    """Encode every whole text and decode it again.

    ``outputs`` are any of ``ids`` (array of ids), ``decoded`` (text),
    ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256``; ``keep`` are columns of ``docs`` to carry along. Added
    tokens in a text become their ids. A null text counts as empty: no ids.
    """
    spark = docs.sparkSession
    vocabulary = ship(spark, "vocabulary", open(vocabulary_path, "rb").read())
    lexicon = ship(spark, "lexicon", build_lexicon(docs, vocabulary_path, most))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    make = {"ids": ("array<bigint>", pa.list_(pa.int64()), lambda ids, _: [int(i) for i in ids.split(",")] if ids else []),
            "decoded": ("string", pa.string(), lambda _, text: text),
            "n_tokens": ("bigint", pa.int64(), lambda ids, _: ids.count(",") + 1 if ids else 0),
            "ids_sha256": ("string", pa.string(), lambda ids, _: digest(ids)),
            "decoded_sha256": ("string", pa.string(), lambda _, text: digest(text))}

    def run(batches: Iterator[pa.RecordBatch]):
        # of the task, so that a worker holds no words while it does other work
        coder = Coder(Vocabulary(SparkFiles.get(vocabulary)), Lexicon(SparkFiles.get(lexicon)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = {name: [] for name in outputs}
                for ids, text in coder.encode(part.column(len(keep)).to_pylist()):
                    for name in outputs:
                        columns[name].append(make[name][2](ids, text))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))]
                                                 + [pa.array(columns[n], make[n][1]) for n in outputs], names=[*keep, *outputs])

    rows = docs.select(*keep, F.col("text").alias("__text"))
    schema = docs.select(*keep).schema
    for name in outputs:
        schema = schema.add(name, DataType.fromDDL(make[name][0]))
    return rows.mapInArrow(run, schema)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
