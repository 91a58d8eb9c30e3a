"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The field tags tokens as begin of a secret, inside one, or outside, from the
token's shape, length and variety, the words and operators around it, and
features of the whole text; Viterbi finds the best tags. It learns from the
fixed patterns' own spans in a bounded sample, from every token of its texts,
and adds spans to theirs where the surroundings and shapes it learned occur
without matching a pattern.

Every token has all features and is scored. Most need no search: where the
learned scores of a token prefer "outside" by more than all transitions and the
next token's change of tag can repay, every best path is "outside" there
(``_certain``). The runs of tokens between such tokens are decoded on their
own, with the same result as decoding the whole text; no weight is changed for
it. What the weights leave open is decoded, however much that is.

Texts are scanned where they lie; there is no shuffle.
"""

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.batches import small_batches

#: Documents that train the field: with a pattern's span, and any.
TRAINING_ROWS = 1500
EPOCHS, RATE = 8, 0.1
#: Steps of an epoch at most, tokens of one training sequence, characters that are split into tokens at once, tokens scored at once.
STEPS, SEQUENCE, PIECE, CHUNK = 250, 1000, 1 << 20, 1 << 16

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

BEGIN, INSIDE, OUTSIDE = range(3)
_TOKEN = re.compile(r"[\w+/.=-]+|[^\w\s]")
_SPACE = re.compile(r"\s")
_PIVOT = re.compile(r"[\d_+/=:-]")
_CUES = {"password", "passwd", "secret", "token", "api", "apikey", "api_key", "key", "auth", "bearer", "credential", "credentials", "access",
         "private", "pwd", "passphrase"}
# Feature templates: number of values of each.
SHAPES = 13
_TEMPLATES = {"quiet": 2, "shape": SHAPES, "length": 9, "variety": 4, "cue": 2, "operator": 2, "quoted": 3, "before": SHAPES + 1, "after": SHAPES + 1,
              "operators_in_text": 3, "codes_in_text": 4, "bias": 1}
_START = dict(zip(_TEMPLATES, np.cumsum([0, *_TEMPLATES.values()]).tolist()))
N_FEATURES = sum(_TEMPLATES.values())


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Spans of the fixed patterns: kind, start, end and where the secret itself starts.

    Matches of one kind are leftmost and do not overlap; a match that is too
    short is dropped with all it covers.
    """
    out = []
    folded = text.lower()
    if any(hint in folded for hint in _ASSIGN_HINTS):
        out += [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def shape(token: str) -> int:
    """Class of a token by the characters it holds."""
    if token in "=:" or token in (":=", "==", "=>"):
        return 0
    if len(token) == 1 and not token.isalnum():
        return 1 if token in "\"'`" else 2
    body = token.strip("=.-")
    digits = any(c.isdecimal() for c in body)
    upper, lower = body != body.lower(), body != body.upper()
    marks = any(c in "+/_=-." for c in body)
    if not digits:
        return 3 if body.isalpha() else 4 if upper and lower and marks else 5
    if not upper and not lower:
        return 6 if body.isdecimal() else 7
    if all(c in "0123456789abcdef" for c in body):
        return 8
    if upper and lower:
        return 9 if not marks else 10
    return 11 if upper else 12


def _length(n: int) -> int:
    return bisect_left((2, 5, 9, 15, 23, 31, 39, 63), n)


def _variety(token: str) -> int:
    if len(token) < 6:
        return 0
    share = len(set(token)) / min(len(token), 16)
    return 1 if share < 0.4 else 2 if share < 0.7 else 3


@dataclass
class Segment:
    """Tokens of one text with the features of each, one row a token."""

    spans: list[tuple[int, int]]
    features: np.ndarray


# A token's code: shape, length, variety, and whether it has a joining mark, is a cue word, is an operator by its characters.
_LENGTH_AT, _VARIETY_AT, _PIVOT_AT, _CUE_AT, _MARK_AT, _CODES = 4, 8, 10, 11, 12, 1 << 13
#: Stands before the first and behind the last token of a text; a text has ``GAP`` of them on either side.
PAD, GAP = 15, 4


class _Codes(dict):
    """Codes of tokens, computed when first asked for; short tokens are kept."""

    KEPT, LONGEST = 50_000, 40

    def __missing__(self, token: str) -> int:
        code = _length(len(token)) << _LENGTH_AT | _variety(token) << _VARIETY_AT | (token.lower() in _CUES) << _CUE_AT
        if token.rstrip(".").isalpha():  # a word, by far the most frequent
            code |= 3
        else:
            code |= shape(token) | bool(_PIVOT.search(token)) << _PIVOT_AT | (token.strip(":=") == "") << _MARK_AT
        if len(token) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.clear()
            self[token] = code
        return code


def _pieces(text: str) -> Iterator[str]:
    """The text, cut at white space into pieces of some ``PIECE`` characters."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def codes_of(text: str, known: _Codes) -> np.ndarray:
    """Codes of all tokens of a text."""
    parts = [np.array(list(map(known.__getitem__, _TOKEN.findall(piece))), np.int16) for piece in _pieces(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.int16)


def _of_text(codes: np.ndarray) -> tuple[int, int]:
    """The features that all tokens of a text share."""
    operators = int(np.count_nonzero(codes >> _MARK_AT & 1))
    marked = int(np.count_nonzero(codes >> _PIVOT_AT & 1)) - operators
    return min(2, operators), int(np.searchsorted((0, 5, 50), marked))


def _around(codes: np.ndarray) -> dict[str, np.ndarray]:
    """Features by neighbours of all but the first ``GAP`` codes and the last."""
    kind = codes & 15
    n = len(codes) - GAP - 1
    back = lambda x, k: x[GAP - k:GAP - k + n]
    quote, assigns, cue = kind == 1, kind == 0, (codes != PAD) & (codes >> _CUE_AT & 1 == 1)
    one, two = back(quote, 1), back(quote, 2)
    operator = back(assigns, 1) | one & (back(assigns, 2) | two & back(assigns, 3))
    pivot = back(codes, 0) >> _PIVOT_AT & 1 == 1
    return {"quiet": ~operator & ~pivot, "cue": back(cue, 1) | back(cue, 2) | back(cue, 3) | back(cue, 4), "operator": operator,
            "quoted": one.astype(np.int8) + (one & back(quote, -1)), "before": back(kind, 1) + 1 & 15, "after": back(kind, -1) + 1 & 15}


def _padded(codes: np.ndarray) -> np.ndarray:
    gap = np.full(GAP, PAD, np.int16)
    return np.concatenate([gap, codes, gap])


def features_of(codes: np.ndarray) -> np.ndarray:
    """Features of all tokens of a text, a row of bytes for each, in the order of the templates."""
    around, (operators, marked) = _around(_padded(codes)[:len(codes) + GAP + 1]), _of_text(codes)
    values = around | {"shape": codes & 15, "length": codes >> _LENGTH_AT & 15, "variety": codes >> _VARIETY_AT & 3,
                       "operators_in_text": operators, "codes_in_text": marked, "bias": 0}
    out = np.empty((len(codes), len(_TEMPLATES)), np.uint8)
    for i, name in enumerate(_TEMPLATES):
        out[:, i] = values[name]
        out[:, i] += _START[name]
    return out


def segments(text: str) -> list[Segment]:
    """All tokens of a text as one segment; none of a text without tokens."""
    codes = codes_of(text, _Codes())
    return [Segment([m.span() for m in _TOKEN.finditer(text)], features_of(codes))] if len(codes) else []


@dataclass
class Field:
    """Weights of the conditional random field."""

    emission: np.ndarray  # feature x tag
    transition: np.ndarray  # tag x tag; outside to inside is impossible

    @cached_property
    def tables(self) -> dict[str, np.ndarray]:
        """Scores by a token's code, by what stands around it and by what its text is like."""
        rows = lambda name, values: self.emission[_START[name] + np.asarray(values)]
        codes = np.arange(_CODES)
        own = rows("shape", np.minimum(codes & 15, SHAPES - 1)) + rows("length", np.minimum(codes >> _LENGTH_AT & 15, 8)) + rows("variety", codes >> _VARIETY_AT & 3)
        near = np.array([(q, c, o, k) for q in range(2) for c in range(2) for o in range(2) for k in range(3)])
        of_text = np.array([(o, m) for o in range(3) for m in range(4)])
        beside = np.zeros((2, 16, 3))
        beside[0, :SHAPES + 1], beside[1, :SHAPES + 1] = rows("before", range(SHAPES + 1)), rows("after", range(SHAPES + 1))
        return {"own": own, "before": beside[0], "after": beside[1],
                "near": sum(rows(name, near[:, i]) for i, name in enumerate(("quiet", "cue", "operator", "quoted"))),
                "text": rows("operators_in_text", of_text[:, 0]) + rows("codes_in_text", of_text[:, 1]) + rows("bias", 0)}

    @cached_property
    def repaid(self) -> tuple[float, float]:
        """Most that transitions gain by another tag than "outside": where no "inside" follows, and where one does and begins a secret instead."""
        t, other = self.transition, (BEGIN, INSIDE)
        into = max(t[p, x] - t[p, OUTSIDE] for p in range(3) for x in other if (p, x) != (OUTSIDE, INSIDE))
        free = max(t[x, n] - t[OUTSIDE, n] for x in other for n in (BEGIN, OUTSIDE))
        inside = max(t[x, INSIDE] for x in other) - t[OUTSIDE, BEGIN] + max(t[INSIDE, m] - t[BEGIN, m] for m in range(3))
        return float(into + free), float(into + inside)


def _transitions(values: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[OUTSIDE, INSIDE] = -1e9
    return out


def _scores(field: Field, features: list[list[int]]) -> np.ndarray:
    return field.emission[np.array(features)].sum(axis=1)


def _path(transition: np.ndarray, scores: np.ndarray) -> list[int]:
    """Best tags of tokens that have "outside" on either side."""
    (bb, bi, bo), (ib, ii, io), (ob, oi, oo) = transition.tolist()
    rows = iter(scores.tolist())
    first = next(rows)
    b, i, o, back = ob + first[0], oi + first[1], oo + first[2], []
    for sb, si, so in rows:
        step = []
        for x, y, z in ((b + bb, i + ib, o + ob), (b + bi, i + ii, o + oi), (b + bo, i + io, o + oo)):
            step.append((0, x) if x >= y and x >= z else (1, y) if y >= z else (2, z))
        back.append((step[0][0], step[1][0], step[2][0]))
        b, i, o = step[0][1] + sb, step[1][1] + si, step[2][1] + so
    b, i, o = b + bo, i + io, o + oo
    tag = 0 if b >= i and b >= o else 1 if i >= o else 2
    tags = [tag]
    for pointer in reversed(back):
        tag = pointer[tag]
        tags.append(tag)
    return tags[::-1]


def viterbi(field: Field, features: list[list[int]]) -> list[int]:
    """Best tags of a segment that has "outside" on either side."""
    return _path(field.transition, _scores(field, features))


def _certain(field: Field, scores: np.ndarray) -> np.ndarray:
    """Tokens that are "outside" on every best path, by their own scores and the next token's; none for the last row.

    From a path with another tag there, one with "outside" is made: an
    "inside" behind it becomes "begin", all else stays. Where that path scores
    more whatever stands around, the first was not the best.
    """
    free, inside = field.repaid
    change = np.maximum(0, scores[1:, INSIDE] - scores[1:, BEGIN])
    gain = scores[:-1, OUTSIDE] - np.maximum(scores[:-1, BEGIN], scores[:-1, INSIDE])
    return gain > np.maximum(free, inside + change) + 1e-6


def open_tokens(field: Field, padded: np.ndarray, whole: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the tokens that need a search; all tokens if ``every``.

    ``padded`` are codes of texts with ``GAP`` pads on either side of each,
    ``whole`` the row of each code in the table of texts.
    """
    tables, places, found = field.tables, [], []
    for lo in range(GAP, len(padded) - GAP, CHUNK):
        hi = min(lo + CHUNK, len(padded) - GAP)
        near = _around(padded[lo - GAP:hi + 2])  # one more, for what the next token may repay
        codes = padded[lo:hi + 1]
        index = ((near["quiet"] * 2 + near["cue"]) * 2 + near["operator"]) * 3 + near["quoted"]
        scores = (tables["own"].take(codes, 0) + tables["near"].take(index, 0) + tables["before"].take(near["before"], 0)
                  + tables["after"].take(near["after"], 0) + tables["text"].take(whole[lo:hi + 1], 0))
        scores[codes == PAD] = (-1e9, -1e9, 0)
        keep = np.flatnonzero((codes[:-1] != PAD) & (every | ~_certain(field, scores)))
        places.append(keep + lo)
        found.append(scores[keep])
    return (np.concatenate(places), np.concatenate(found)) if places else (np.empty(0, np.int64), np.empty((0, 3)))


def learned(texts: list[str], field: Field, known: _Codes, every: bool = False) -> list[list[tuple[int, int]]]:
    """First and last token of every span that the field finds, by text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    parts, rows, starts, at = [np.full(GAP, PAD, np.int16)], [np.zeros(GAP, np.int8)], [], GAP
    for text in texts:
        codes = codes_of(text, known)
        operators, marked = _of_text(codes)
        starts.append(at)
        parts += [codes, parts[0]]
        rows.append(np.full(len(codes) + GAP, operators * 4 + marked, np.int8))
        at += len(codes) + GAP
    places, scores = open_tokens(field, np.concatenate(parts), np.concatenate(rows), every)
    if not len(places):
        return out
    cuts = np.flatnonzero(np.diff(places) != 1) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
        run = scores[lo:hi]
        if hi - lo == 1 and (field.transition[OUTSIDE, [BEGIN, OUTSIDE]] + run[0, [BEGIN, OUTSIDE]] + field.transition[[BEGIN, OUTSIDE], OUTSIDE]).argmax() == 1:
            continue
        tags, first = _path(field.transition, run), int(places[lo])
        text = bisect_right(starts, first) - 1
        i = 0
        while i < len(tags):
            if tags[i] != BEGIN:
                i += 1
                continue
            j = i + 1
            while j < len(tags) and tags[j] == INSIDE:
                j += 1
            out[text].append((first + i - starts[text], first + j - 1 - starts[text]))
            i = j
    return out


def _sums(emission: np.ndarray, transition: np.ndarray, index: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tags of every token and expected transitions, of sequences side by side.

    ``index`` has the features of place x sequence; behind its end, a sequence
    is "outside" for certain. Sums are of probabilities, scaled at every place.
    """
    n, width = index.shape[:2]
    scores = emission[index].sum(axis=2)
    scores[np.arange(n)[:, None] >= lengths] = (-np.inf, -np.inf, 0)
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    trans = _transitions(transition)
    moves = np.exp(trans - trans.max())
    forward, backward, scale = np.empty((n, width, 3)), np.empty((n, width, 3)), np.empty((n, width, 1))
    row = moves[OUTSIDE] * local[0]
    for t in range(n):
        if t:
            row = row @ moves * local[t]
        scale[t] = row.sum(axis=1, keepdims=True)
        row = row / scale[t]
        forward[t] = row
    back = np.broadcast_to(moves[:, OUTSIDE], (width, 3))
    last = (forward[-1] * back).sum(axis=1, keepdims=True)
    back = back / last
    backward[-1] = back
    for t in range(n - 2, -1, -1):
        back = (local[t + 1] * back / scale[t + 1]) @ moves.T
        backward[t] = back
    node = forward * backward
    ahead = local[1:] * backward[1:] / scale[1:]
    real = np.arange(1, n)[:, None] < lengths
    edge = np.einsum("twi,twj->ij", forward[:-1][real][:, None], ahead[real][:, None]) * moves if n > 1 else np.zeros((3, 3))
    edge[OUTSIDE] += node[0].sum(axis=0)
    ends = node[lengths - 1, np.arange(width)]
    edge[:, OUTSIDE] += ends.sum(axis=0)
    return node, edge


def train(sequences: list[tuple[np.ndarray, list[int]]], seed: int = 3) -> Field:
    """Maximum likelihood by stochastic gradient descent with forward-backward sums.

    A step takes sequences of like length side by side, all their tokens in
    whole, and moves every weight by the running mean of its slope over that of
    its size (Adam), less towards the end.
    """
    rng = np.random.default_rng(seed)
    emission = np.zeros((N_FEATURES, 3))
    emission[_START["bias"], OUTSIDE] = 2.0  # what was never seen is outside
    transition = np.zeros((3, 3))
    means = [np.zeros((N_FEATURES, 3)), np.zeros((3, 3)), np.zeros((N_FEATURES, 3)), np.zeros((3, 3))]  # of slopes and of their squares
    done = 0
    width = max(1, -(-len(sequences) // STEPS))
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][1]))
    groups = [order[i:i + width] for i in range(0, len(order), width)]
    for _ in range(EPOCHS):
        for g in rng.permutation(len(groups)):
            chosen = [(np.asarray(sequences[i][0]), np.asarray(sequences[i][1])) for i in groups[g]]
            lengths = np.array([len(tags) for _, tags in chosen])
            index = np.zeros((lengths.max(), len(chosen), chosen[0][0].shape[1]), np.uint8)
            tags = np.full(index.shape[:2], OUTSIDE, np.int8)
            for k, (features, own) in enumerate(chosen):
                index[:len(own), k], tags[:len(own), k] = features, own
            node, edge = _sums(emission, transition, index, lengths)
            real = np.arange(len(index))[:, None] < lengths
            index, node, own = index[real], node[real], tags[real]
            node[np.arange(len(own)), own] -= 1
            ids = index.ravel()
            step = np.stack([np.bincount(ids, np.repeat(node[:, k], index.shape[1]), N_FEATURES) for k in range(3)], axis=1)
            both = real[1:]
            np.subtract.at(edge, (tags[:-1][both], tags[1:][both]), 1)
            np.subtract.at(edge, (OUTSIDE, tags[0]), 1)
            np.subtract.at(edge, (tags[lengths - 1, np.arange(len(chosen))], OUTSIDE), 1)
            edge[OUTSIDE, INSIDE] = 0
            done += 1
            rate = RATE * (1 - done / (EPOCHS * len(groups) + 1))
            for k, (weights, slope) in enumerate(((emission, step), (transition, edge))):
                means[k] = 0.9 * means[k] + 0.1 * slope
                means[k + 2] = 0.99 * means[k + 2] + 0.01 * slope**2
                weights -= rate * means[k] / (1 - 0.9**done) / (np.sqrt(means[k + 2] / (1 - 0.99**done)) + 1e-3)
    return Field(emission, _transitions(transition))


def weak_tags(spans: list[tuple[int, int]], base: list[tuple[int, int, int, int]]) -> list[int]:
    """Tags of tokens by the secrets that the fixed patterns found; tokens and spans in order."""
    secret, tags, last, at = sorted({(s[3], s[2]) for s in base}), [], None, 0
    for start, end in spans:
        while at < len(secret) and secret[at][1] <= start:
            at += 1
        hit, i = None, at
        while hit is None and i < len(secret) and secret[i][0] < end:
            hit = secret[i] if start < secret[i][1] else None
            i += 1
        tags.append(OUTSIDE if hit is None else INSIDE if hit == last else BEGIN)
        last = hit
    return tags


def fit(docs: DataFrame, rows: int = TRAINING_ROWS) -> Field:
    """Train on at most ``rows`` documents with a fixed pattern's span and ``rows`` of all.

    They are those with the least hash of their text, so the sample does not
    depend on how the table is stored; equal texts count once. All tokens of
    their texts train, in sequences of ``SEQUENCE`` tokens; at most ``8 * rows``
    sequences of features and tags, 13 bytes a token, reach the driver.
    """
    rough = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
    rows_of = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.xxhash64("text"))
    some = rows_of.groupBy("place").agg(F.lit(1)).select("place").orderBy("place").limit(rows)
    marked = (rows_of.where(F.col("text").rlike(rough)).groupBy("place").agg(F.lit(1)).select("place").orderBy("place").limit(rows))
    chosen = some.union(marked).distinct()  # at most 2 * rows hashes
    sample = rows_of.join(F.broadcast(chosen), "place", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                base, out = base_spans(text), []
                for segment in segments(text):
                    tags = np.array(weak_tags(segment.spans, base), np.uint8)
                    for at in range(0, len(tags), SEQUENCE):
                        out.append((segment.features[at:at + SEQUENCE].tobytes(), tags[at:at + SEQUENCE].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in range(2)], names=["features", "tags"])

    made = sample.mapInArrow(run, "features binary, tags binary").distinct()
    found = sorted((bytes(r.features), bytes(r.tags)) for r in made.orderBy(F.xxhash64("features", "tags"), "features", "tags").limit(8 * rows).collect())
    return train([(np.frombuffer(f, np.uint8).reshape(-1, len(_TEMPLATES)), np.frombuffer(t, np.uint8)) for f, t in found])


def all_spans(texts: list[str], field: Field, known: _Codes, every: bool = False) -> list[list[tuple[int, int, int, int]]]:
    """All spans of texts: the fixed patterns' and those the field adds beside them."""
    found = []
    for text, runs in zip(texts, learned(texts, field, known, every)):
        base = base_spans(text)
        out = list(base)
        if runs:
            ends = {i for run in runs for i in run}
            at = {i: m.span() for i, m in enumerate(_TOKEN.finditer(text)) if i in ends}
            for first, last in runs:
                start, end = at[first][0], at[last][1]
                if not any(s[1] < end and start < s[2] for s in base):
                    out.append((3, start, end, start))
        found.append(sorted(out, key=lambda s: (s[1], s[0])))
    return found


def spans_of(text: str, field: Field, every: bool = False) -> list[tuple[int, int, int, int]]:
    """All spans of one text; ``every`` token is searched, also where its scores settle the tag."""
    return all_spans([text], field, _Codes(), every)[0]


def joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in spans)


def redact(text: str, spans: list[tuple[int, int, int, int]]) -> str:
    """The text with every secret replaced by ``[SECRET]``; the word before an assignment stays."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end in sorted((s[3], s[2]) for s in spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


def _scanned(texts: Iterable[str | None], field: Field, known: _Codes) -> Iterator[tuple[str | None, str, list[tuple[int, int, int, int]]]]:
    """Texts with their spans, in groups of some ``PIECE`` characters."""
    group: list[str | None] = []
    held = 0
    for text in texts:
        group.append(text)
        held += len(text or "")
        if held >= PIECE:
            whole = [t or "" for t in group]
            yield from zip(group, whole, all_spans(whole, field, known))
            group, held = [], 0
    whole = [t or "" for t in group]
    yield from zip(group, whole, all_spans(whole, field, known))


def scan(docs: DataFrame, field: Field, redacted: bool = False) -> DataFrame:
    """Add ``n_assign, n_access, n_hex, n_model, base_sha256, spans`` to ``docs``; a null text counts as empty.

    Columns of these names are replaced. With ``redacted`` the text itself
    loses its secrets; a null text stays null.
    """
    added = ["n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"]
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(field)
    schema = "n_assign bigint, n_access bigint, n_hex bigint, n_model bigint, base_sha256 string, spans string, text string"

    @F.pandas_udf(schema)
    def scanned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, known = shared.value, _Codes()
        for part in parts:
            rows = []
            for text, whole, spans in _scanned(part, model, known):
                counts = [sum(s[0] == k for s in spans) for k in range(4)]
                base = hashlib.sha256(joined([s for s in spans if s[0] < 3]).encode()).hexdigest()
                rows.append((*counts, base, joined(spans), redact(whole, spans) if redacted and text is not None else None))
            yield pd.DataFrame(rows, columns=[*added, "text"])

    found = docs.drop(*added).withColumn("__found", scanned("text"))
    if redacted:
        found = found.withColumn("text", F.col("__found.text"))
    return found.select([f"`{c}`" for c in found.columns if c != "__found"] + [F.col(f"__found.{c}").alias(c) for c in added])
