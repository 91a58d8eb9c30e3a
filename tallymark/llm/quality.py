"""Quality classifier: supervised subword embeddings.

A text's features are its words, its pairs of neighbouring words and the
character n-grams of its words, hashed into a fixed number of buckets, a mark
wherever a word repeats the one before, and one end mark that every text has. Each
bucket has a learned vector; a text is the average of its vectors, and a
softmax over two classes is trained with it by stochastic gradient descent.

The average is linear, so at scoring time a bucket only needs one number, its
vector's product with the difference of the two output vectors: the broadcast
model is one float per bucket whatever the corpus, and whole texts are scored
where they lie, without a shuffle.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.batches import small_batches
from tallymark.llm.hashing import mix

#: Hash buckets of words and n-grams; bucket 0 is the end mark, bucket 1 the mark of a repeated word.
BUCKETS = 1 << 18
#: Lengths of the character n-grams; they may begin and end at a word's borders.
GRAMS = (3, 4)
DIMENSIONS = 16
EPOCHS = 4
RATE = 2.0
#: Labelled rows that train the model, those with the smallest hash of their id.
TRAINING_ROWS = 4000
#: Characters featurised at once; a longer text goes on at the next white space.
BLOCK = 1 << 20

_RNG = np.random.default_rng(11)
_A, _B = (_RNG.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
_UP, _DOWN = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int):
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, 1 << 15)
        _UP, _DOWN = np.full(size, _A, np.uint64), np.full(size, pow(_A, -1, 2**64), np.uint64)
        for table in (_UP, _DOWN):
            table[0] = 1
            np.multiply.accumulate(table, out=table)
    return _UP, _DOWN


def _blocks(codes: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(codes):
        end = at + BLOCK
        if end < len(codes):
            gap = np.flatnonzero(codes[end:] <= 32)
            end = end + int(gap[0]) if len(gap) else len(codes)
        yield codes[at:end]
        at = end


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(BUCKETS - 2)).astype(np.int64) + 2


def _block_features(codes: np.ndarray, before: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Features of a block, and the hash of its last word; ``before`` is that of the block before, if any."""
    blank = (codes <= 32) | (codes == 0xA0) | (codes == 0x3000)
    # one border between words, one at either end
    keep = np.concatenate(([True], ~(blank[1:] & blank[:-1]))) if len(blank) else blank
    codes, blank = np.where(blank, 32, codes)[keep], blank[keep]
    codes = np.concatenate(([32], codes[int(blank[0]):len(codes) - int(blank[-1])], [32])).astype(np.uint64)
    if len(codes) < 3:
        return [], before
    border = codes == 32
    at = np.flatnonzero(border)
    start, end = at[:-1] + 1, at[1:]
    up, down = _powers(len(codes) + 1)
    spread = (codes + np.uint64(1)) * np.uint64(_B)
    spread ^= spread >> np.uint64(29)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread * up[:len(codes)])))
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    run = np.concatenate((before, words))
    pairs = mix(run[:-1] * np.uint64(_A) + run[1:])
    out = [_bucket(words), _bucket(pairs), np.ones(int((run[1:] == run[:-1]).sum()), np.int64)]
    rolling, inner = spread.copy(), None
    for n in range(2, max(GRAMS) + 1):
        rolling = rolling[:len(codes) - n + 1] * np.uint64(_A) + spread[n - 1:]
        if n > 2:
            # no border strictly inside
            last = border[n - 2:len(codes) - 1]
            inner = last.copy() if inner is None else inner[:len(last)] | last
        if n in GRAMS and len(rolling):
            grams = rolling[~inner]
            out.append(_bucket((grams + np.uint64(n)) * np.uint64(_B) ^ (grams >> np.uint64(31))))
    return out, words[-1:]


def features(text: str | None) -> np.ndarray:
    """Bucket of every feature occurrence of a whole text; the end mark last."""
    out, last = [], np.zeros(0, np.uint64)
    if text:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for block in _blocks(codes):
            found, last = _block_features(block, last)
            out += found
    return np.concatenate([*out, np.zeros(1, np.int64)])


@dataclass
class Model:
    """Vectors of the buckets and of the two classes."""

    vectors: np.ndarray
    classes: np.ndarray

    def weights(self) -> np.ndarray:
        """What a bucket adds to the difference of the two classes' scores."""
        return self.vectors @ (self.classes[1] - self.classes[0])


def probability(weights: np.ndarray, text: str | None) -> float:
    """Softmax probability of class 1."""
    return float(1 / (1 + np.exp(-np.clip(weights[features(text)].mean(), -500, 500))))


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Stochastic gradient descent over one text at a time, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    classes = np.zeros((2, DIMENSIONS))
    steps, total = 0, max(1, EPOCHS * len(texts))
    rows = []
    for text in texts:
        ids, counts = np.unique(features(text), return_counts=True)
        rows.append((ids.astype(np.int32), (counts / counts.sum()).astype(np.float32)))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            rate = RATE * (1 - steps / total)
            hidden = share @ vectors[ids]
            z = classes @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ classes
            classes -= rate * np.outer(p, hidden)
            vectors[ids] -= rate * share[:, None] * back
            steps += 1
    return Model(vectors, classes)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Train on at most ``rows`` labelled documents that are not held out.

    Only texts and labels are read. Of several labels of one document the
    least counts; rows without id or label train nothing. Without any labelled
    row the model scores every text 0.5.
    """
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect())
    return train([r.text for r in sample], [r.quality for r in sample])


def _probabilities(docs: DataFrame, model: Model):
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model.weights())

    @F.pandas_udf("double")
    def probabilities(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = shared.value
        for part in parts:
            yield pd.Series([probability(weights, t) for t in part], dtype="float64")

    return probabilities(F.col("text"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score``, the probability of quality 1; a null text counts as empty.

    A column ``score`` that is there already is replaced; all others are kept.
    """
    return docs.withColumn("score", _probabilities(docs, model))


def accepted(docs: DataFrame, model: Model, at: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``at``, unchanged."""
    return docs.where(_probabilities(docs, model) >= at)


def threshold(scored: DataFrame, at: float = 0.7) -> DataFrame:
    """Add ``predicted``: 1 where the score reaches ``at``."""
    return scored.withColumn("predicted", F.when(F.col("score") >= at, 1).otherwise(0))
