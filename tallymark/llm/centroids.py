"""Clustering of vectors around centroids with a vantage-point tree.

Every round builds a tree over the centroids on the driver and broadcasts it;
the number of centroids is a parameter, so the broadcast is bounded and does
not grow with the vectors. A node holds one centroid and, for each of its two
subtrees, the smallest and largest distance from its centroid to theirs. A
vector walks the tree best first: it visits the node with the least lower
bound, and stops when that bound exceeds the best distance so far. The radius
is inclusive, so a centroid at exactly the best distance is seen as well, and
of equally near ones the smallest number wins. Bounds are floating point with
room for rounding; distances at the nodes are exact integers.

Tasks add up the vectors of each cluster, and only those sums, cut into limbs
of 40 bits that cannot overflow, are shuffled.

Nulls, ties and odd rows: a vector that is null, of another length, or with a
null or non-finite component is in no result row. Rows of one ``vec_id`` are
rows like any other. A row without ``vec_id`` is clustered, and starts a
centroid only when no row with an id is left. Fewer vectors than centroids
start fewer centroids; an empty table gives an empty result. A component whose
integer passes ``COMPONENT`` makes its vectors compare with every centroid in
unbounded integers; a distance or inertia that passes the range of a long is
null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialise

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Largest size of a component for which squared distances of 64 fit a long.
COMPONENT = 1 << 26
#: Bits in a limb of an exact sum, and vectors that walk the tree together.
LIMB, GROUP = 40, 4096
_NONE = np.iinfo(np.int64).max


class Tree:
    """Vantage-point tree over integer points."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.children: list[list[tuple[int, float, float]]] = [[] for _ in points]  # node, least and largest distance
        self.root = self._build(list(range(len(points)))) if len(points) else -1

    def _build(self, members: list[int]) -> int:
        root, stack = members[0], [(members[0], members[1:])]
        while stack:
            node, rest = stack.pop()
            if not rest:
                continue
            away = np.sqrt(((self.points[rest] - self.points[node]) ** 2).sum(1).astype(np.float64))
            order = np.argsort(away, kind="stable")
            half = (len(rest) + 1) // 2
            for part in (order[:half], order[half:]):
                if len(part):
                    inside = [rest[i] for i in part.tolist()]
                    self.children[node].append((inside[0], float(away[part[0]]), float(away[part[-1]])))
                    stack.append((inside[0], inside[1:]))
        return root

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest point, and how many distances it took."""
        n = len(vectors)
        best, which, steps = np.full(n, _NONE), np.full(n, -1), 0
        bound = np.full((n, len(self.points)), np.inf)
        bound[:, self.root] = 0.0
        live = np.arange(n)
        while len(live):
            node = bound[live].argmin(1)
            low = bound[live, node]
            radius = np.sqrt(best[live].astype(np.float64))
            go = low <= radius * (1 + 1e-9) + 1e-3
            go &= np.isfinite(low)
            live, node, low = live[go], node[go], low[go]
            for at in np.unique(node).tolist():
                mine = node == at
                rows, floor_ = live[mine], low[mine]
                gap = vectors[rows] - self.points[at]
                square = np.einsum("ij,ij->i", gap, gap)
                steps += len(rows)
                closer = (square < best[rows]) | ((square == best[rows]) & (at < which[rows]))
                best[rows[closer]], which[rows[closer]] = square[closer], at
                bound[rows, at] = np.inf
                away = np.sqrt(square.astype(np.float64))
                for child, least, most in self.children[at]:
                    bound[rows, child] = np.maximum(floor_, np.maximum(away - most, least - away))
        return which, best, steps


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of doubles, in longs where all fit and in Python integers otherwise."""
    if not values.size or np.abs(values).max() * scale <= COMPONENT:
        return np.floor(values * scale).astype(np.int64)
    return np.array([[floor(Fraction(x) * scale) for x in row] for row in values.tolist()], object)


def vectors_of(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """Integer matrix of a list column whose rows all have ``size`` components."""
    return _integers(np.asarray(column.flatten(), np.float64).reshape(-1, size), scale)


def assign(vectors: np.ndarray, tree: Tree) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """Nearest centroid and exact squared distance of each vector."""
    if vectors.dtype == object or tree.points.dtype == object:
        which, away = [], []
        for v in vectors.astype(object):
            square = [int(sum((v - c) ** 2)) for c in tree.points.astype(object)]
            which.append(square.index(min(square)))
            away.append(min(square))
        return np.array(which, np.int64), away
    parts = [tree.nearest(vectors[i:i + GROUP])[:2] for i in range(0, len(vectors), GROUP)]
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _tree(centroids: list[list[int]]) -> Tree:
    wide = any(abs(x) > COMPONENT for c in centroids for x in c)
    if not wide:
        return Tree(np.array(centroids, np.int64))
    tree = Tree.__new__(Tree)
    tree.points, tree.children, tree.root = np.array(centroids, object), [], 0
    return tree


def limbs(x: int) -> list[int]:
    """Digits of 40 bits, the last one signed."""
    out = []
    while abs(x) >= 1 << LIMB:
        out.append(x & ((1 << LIMB) - 1))
        x >>= LIMB
    return [*out, x]


def kept(vectors: DataFrame, size: int = DIMENSIONS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` of the vectors with ``size`` finite components."""
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where((F.size(x) == size) & ~bad).select(F.col(vec_id).alias("vec_id"), x.alias("embedding"))


def _start(rows: DataFrame, clusters: int, size: int, scale: int, seed: int) -> list[list[int]]:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "embedding").limit(clusters).select("embedding").collect()
    return [[int(x) for x in row] for row in _integers(np.array([r.embedding for r in first], np.float64).reshape(-1, size), scale)]


def _move(rows: DataFrame, centroids: list[list[int]], size: int, scale: int) -> list[list[int]]:
    """Centroids after one round."""
    shared = rows.sparkSession.sparkContext.broadcast(_tree(centroids))

    def run(batches: Iterator[pa.RecordBatch]):
        totals: dict[int, list] = {}
        for batch in batches:
            vectors = vectors_of(batch.column(0), size, scale)
            which, _ = assign(vectors, shared.value)
            for c in np.unique(which).tolist():
                mine = vectors[which == c]
                total = totals.setdefault(c, [0, np.zeros(size, object)])
                total[0] += len(mine)
                total[1] = total[1] + mine.sum(0).astype(object)
        out = [(c, i, j, limb) for c, (n, sums) in totals.items()
               for i, value in enumerate([n, *sums.tolist()]) for j, limb in enumerate(limbs(int(value)))]
        columns = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["cluster", "place", "limb", "value"])

    sums = (rows.select("embedding").mapInArrow(run, "cluster int, place int, limb int, value bigint")
            .groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")))
    totals: dict[tuple[int, int], int] = {}
    for r in sums.collect():  # a few rows for each component of each centroid
        totals[r.cluster, r.place] = totals.get((r.cluster, r.place), 0) + (r.value << (LIMB * r.limb))
    shared.unpersist()
    return [[totals[c, i + 1] // totals[c, 0] for i in range(size)] if totals.get((c, 0)) else old for c, old in enumerate(centroids)]


def digest(centroid: list[int]) -> str:
    """SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _long(x: int) -> int | None:
    return x if x <= _NONE else None


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = DIMENSIONS, scale: int = SCALE,
            seed: int = SEED) -> DataFrame:
    """Cluster, squared distance and inertia of every usable vector after ``rounds`` rounds.

    Returns ``vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256``; other columns of ``vectors`` are not read.
    """
    spark = vectors.sparkSession
    rows = materialise(kept(vectors, size))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint"
    centroids = _start(rows, clusters, size, scale, seed)
    for _ in range(rounds if centroids else 0):
        moved = _move(rows, centroids, size, scale)
        if moved == centroids:
            break  # every later round would give the same
        centroids = moved
    shared = spark.sparkContext.broadcast(_tree(centroids) if centroids else None)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            which, away = assign(vectors_of(batch.column(1), size, scale), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which, pa.int32()), pa.array([_long(int(d)) for d in away], pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    found = materialise(rows.mapInArrow(run, schema))
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: (r.total, r.n == r.known) for r in
               found.groupBy("cluster").agg(wide.alias("total"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()}
    sums = {c: int(t) if whole else None for c, (t, whole) in inertia.items()}
    whole = None if None in sums.values() else _long(sum(sums.values()))
    facts = [(c, sums[c] and _long(sums[c]), whole, digest(centroids[c])) for c in sums]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """SQL for the rows of :func:`cluster` over ``embeddings`` with distinct ids."""
    down = "((s - ((s % n) + n) % n) // n)"
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, unnest(range({size})) AS i,
    unnest([CAST(floor(x::DOUBLE * {scale}) AS BIGINT) FOR x IN embedding]) AS x FROM embeddings
    WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"""s AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY h) - 1 AS k FROM (SELECT DISTINCT vec_id,
    sha256('{seed}:' || vec_id::VARCHAR) AS h FROM v) ORDER BY h LIMIT {clusters})""",
             "c0 AS MATERIALIZED (SELECT k, i, x FROM v JOIN s USING (vec_id))"]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, arg_min(k, d * {clusters} + k) AS k, min(d) AS d FROM (SELECT v.vec_id, c.k,
    sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (i) GROUP BY v.vec_id, c.k) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT k, i, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN (SELECT k, i, {down} AS x FROM
    (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY k, i)) m USING (k, i))""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
    h AS centroid_sha256 FROM a{rounds} JOIN (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k) USING (k)"""


ORACLE = oracle()
