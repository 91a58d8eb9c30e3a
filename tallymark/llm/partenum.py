"""Exact Jaccard self-join of word n-gram sets by PartEnum signatures.

Two sets of sizes a and b with Jaccard similarity of at least ``t = num/den``
differ in at most ``(den - num) * (a + b) / (den + num)`` elements. Sizes are
cut into bands so that linked sets lie in the same or in neighbouring bands;
every set signs for its own band and for the next. For a band whose sets may
differ in ``k`` elements, the feature domain is partitioned by hash into
``n1 = ceil((k + 1) / 2) + m`` parts, ``m + 1`` of which then hold at most one
difference; each part is cut into three, and the subsets of two of the three
are enumerated: one of them has no difference. So linked sets share at least
``m + 1`` of ``3 * n1`` signatures, from different parts. A subset that hardly
holds a feature says nothing and is shared by unrelated sets, so a set leaves
out its weak signatures where at most ``m`` of its parts have any: a partner
still shares one that is not weak, and what is not weak nobody leaves out.

Rows flow as follows; nothing is collected, no group is expanded into pairs:

1. every text becomes ``(n_shingles, node)``; ``node`` is a hash of its set, so
   exact copies are one node from here on;
2. signatures are shuffled once, sorted, and streamed; only those that several
   nodes share are kept (``members``);
3. in every signature group the node with most shared signatures is the hub;
   of the hubs whose parity bitmap (a lower bound of the number of
   differences) allows a link, the one with most common signatures is checked
   exactly against the node; components follow from these links;
4. groups whose nodes lie in several components are searched again in blocks of
   bounded size: pairs from different components whose bitmaps allow a link
   are checked exactly.
   After that every linked pair has been checked or was connected before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.batches import small_batches
from tallymark.llm.hashing import mix, set_hash, shingles, words_of
from tallymark.session import join_small, materialise

#: Nodes of a signature group that one task compares at once, per side.
BLOCK_NODES = 4096
#: Texts whose sets a task holds at once.
SLICE_ROWS = 250
#: Bits of the parity bitmap of a set.
BITMAP_BITS = 1024
#: Candidate nodes up to which the list of them is broadcast (16 bytes each).
BROADCAST_NODES = 500_000
#: Pairs that a task holds before it hands them on.
PAIRS_AT_ONCE = 10_000


def band_of(size: int, num: int, den: int, bands: list[int]) -> int:
    """Number of the size band; ``bands`` holds the upper ends, extended as needed."""
    while bands[-1] < size:
        bands.append(max(bands[-1] + 1, den * (bands[-1] + 1) // num))
    return int(np.searchsorted(bands, size))


def _bands(num: int, den: int) -> list[int]:
    return [max(1, den // num)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose sets are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    return [shingles(w, size) for w in words_of(batch.column("text"))]


def _bitmap(values: np.ndarray) -> np.ndarray:
    counts = np.bincount((values >> np.uint64(20)).astype(np.int64) % BITMAP_BITS, minlength=BITMAP_BITS)
    return np.packbits(counts & 1).view(np.int64)


def features(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, proof, bitmap`` of every row.

    ``node`` and ``proof`` are two hashes of the set of shingles; both are null
    for a text without words.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for part in _slices(batches):
            sets = _sets(part, size)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("text_hash"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_hash(s, 1) if len(s) else None for s in sets], pa.int64()),
                pa.array([set_hash(s, 2) if len(s) else None for s in sets], pa.int64()),
                pa.array([_bitmap(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ], names=["doc_id", "text_hash", "n_shingles", "node", "proof", "bitmap"])

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, proof bigint, bitmap array<bigint>")


def _cells(sets: list[np.ndarray], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wrapping sum and number of the elements in each of the ``3 * parts`` cells of every set."""
    lengths = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum(3 * parts)))
    spread = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    owner_parts = np.repeat(parts, lengths).astype(np.uint64)
    level_one = ((spread >> np.uint64(32)) * owner_parts) >> np.uint64(32)
    level_two = ((spread & np.uint64(0xFFFFFFFF)) * np.uint64(3)) >> np.uint64(32)
    cell = np.repeat(first[:-1], lengths) + (level_one * np.uint64(3) + level_two).astype(np.int64)
    low = np.bincount(cell, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), first[-1]).astype(np.uint64)
    high = np.bincount(cell, (values >> np.uint64(32)).astype(np.float64), first[-1]).astype(np.uint64)
    return low + (high << np.uint64(32)), np.bincount(cell, minlength=first[-1])


def _left_out(weight: np.ndarray, owner: np.ndarray, n: int, spare: np.ndarray) -> np.ndarray:
    """Which signatures to leave out: those of at most one feature, or of none, where few enough parts have such.

    ``weight`` counts the features of each part's three subsets.
    """
    out = np.zeros(weight.shape, bool)
    for most in (0, 1):
        weak = weight <= most
        rare = np.bincount(owner, weak.any(axis=1), n) <= spare
        out |= weak & rare[owner][:, None]
    return out


def signature_rows(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``sets`` and signatures; sets that can only link to equals have none."""
    bands, owners, out = _bands(num, den), [], []
    for shift in (0, 1):
        take, parts, band = [], [], []
        for i, values in enumerate(sets):
            if not len(values):
                continue
            b = band_of(len(values), num, den, bands) + shift
            while b >= len(bands):
                band_of(bands[-1] + 1, num, den, bands)
            k = (den - num) * 2 * bands[b] // (den + num)
            if k:
                take.append(i), parts.append((k + 2) // 2), band.append(b)
        if not take:
            continue
        parts, band = np.array(parts), np.array(band)
        spare = 1 + parts // 10
        parts = parts + spare
        sums, counts = _cells([sets[i] for i in take], parts)
        sums, counts = mix(sums).reshape(-1, 3), counts.reshape(-1, 3)
        owner = np.repeat(np.arange(len(take)), parts)
        dropped = _left_out(np.stack([counts[:, (j + 1) % 3] + counts[:, (j + 2) % 3] for j in range(3)], axis=1), owner, len(take), spare)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        place = mix(band[owner].astype(np.uint64) << np.uint64(32) | within.astype(np.uint64))
        for left_out in range(3):
            a, b = sums[:, (left_out + 1) % 3], sums[:, (left_out + 2) % 3]
            use = ~dropped[:, left_out]
            out.append(mix(mix(place + np.uint64(left_out + 1) + a) + b)[use])
            owners.append(np.array(take)[owner[use]])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(out)


def signatures(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``sig, node`` of every text; copies within a batch sign once."""

    def run(batches: Iterator[pa.RecordBatch]):
        for part in _slices(batches):
            by_node = {set_hash(s, 1): s for s in _sets(part, size) if len(s)}
            nodes = np.array(list(by_node), np.int64)
            owner, sig = signature_rows(list(by_node.values()), num, den)
            yield pa.RecordBatch.from_arrays([pa.array(sig.astype(np.int64)), pa.array(nodes[owner])], names=["sig", "node"])

    return docs.select("text").mapInArrow(run, "sig bigint, node bigint")


def _members(rows: DataFrame) -> DataFrame:
    """Distinct ``sig, node`` rows of the signatures that several nodes share.

    Streams sorted rows; one row is held back between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        sig, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keep_first = False  # the held row belongs to a group that has more nodes
        for batch in batches:
            sig = np.concatenate([sig, batch.column("sig").to_numpy()])
            node = np.concatenate([node, batch.column("node").to_numpy()])
            if len(sig) < 2:
                continue
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
            sig, node = sig[new], node[new]
            same = sig[1:] == sig[:-1]
            shared = np.concatenate(([keep_first], same)) | np.concatenate((same, [False]))
            keep_first = bool(len(same) and same[-1]) or (len(sig) == 1 and keep_first)
            out = shared[:-1]
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[:-1][out]), pa.array(node[:-1][out])], names=["sig", "node"])
            sig, node = sig[-1:], node[-1:]
        if len(sig) and keep_first:
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], names=["sig", "node"])

    return rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, "sig bigint, node bigint")


def _stars(members: DataFrame) -> DataFrame:
    """``hub, node, common``: how many signature groups a node shares with each hub."""
    shared = members.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    ranked = (members.join(shared, "node").repartition("sig")
              .sortWithinPartitions("sig", F.col("shared").desc(), "node"))

    def run(batches: Iterator[pa.RecordBatch]):
        last, hub = None, 0
        for batch in batches:
            sig, node = batch.column("sig").to_numpy(), batch.column("node").to_numpy()
            first = np.concatenate(([last is None or sig[0] != last], sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, bool)
            if not len(sig):
                continue
            group = np.cumsum(first)
            hubs = np.concatenate(([hub], node[first]))[group]
            last, hub = sig[-1], hubs[-1]
            pairs, counts = np.unique(np.stack([hubs, node])[:, hubs != node], axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(counts.astype(np.int64))],
                                             names=["hub", "node", "n"])

    return (ranked.mapInArrow(run, "hub bigint, node bigint, n bigint")
            .groupBy("hub", "node").agg(F.sum("n").alias("common")))


def _possible(stars: DataFrame, sized: DataFrame, num: int, den: int) -> DataFrame:
    """The stars whose sizes and bitmaps allow a link."""
    hub = sized.select(F.col("node").alias("hub"), F.col("n_shingles").alias("nh"), F.col("bitmap").alias("bh"))
    apart = F.aggregate(F.zip_with("bitmap", "bh", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    both = stars.join(sized, "node").join(hub, "hub")
    return (both.where(F.greatest(apart, F.abs(F.col("nh") - F.col("n_shingles"))) * (den + num) <= (den - num) * (F.col("nh") + F.col("n_shingles")))
            .select("hub", "node", "common"))


def _check(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the similarity, by the whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").where(den * both >= num * union).select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of an undirected graph ``a, b``.

    Alternates large-star and small-star steps over written tables until
    nothing changes; the label is the least node of the component.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large)
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        small = materialise(small)
        if not small.exceptAll(edges).limit(1).count() and not edges.exceptAll(small).limit(1).count():
            break
        edges = small
    # every node now points at the least of its component
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label")).distinct()


def _across(members: DataFrame, labels: DataFrame, sized: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one signature group and different components that may be linked.

    A group of n nodes is cut into ceil(n / BLOCK_NODES) blocks and every two
    blocks meet in one task, so a task never holds more than two blocks.
    """
    rows = materialise(members.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label")))
    mixed = (rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
             .where("lo < hi").select("sig", F.ceil(F.col("n") / BLOCK_NODES).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tasks = (rows.join(materialise(mixed), "sig").join(sized, "node").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))
    tasks = tasks.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def pairs(part: pa.Table, seen: set):
        node, label = part["node"].to_numpy(), part["label"].to_numpy()
        size, own = part["n_shingles"].to_numpy(), part["own"].to_numpy()
        bits = pc.list_flatten(part["bitmap"]).to_numpy().view(np.uint64).reshape(len(node), -1)
        lone = part["i"][0].as_py() == part["j"][0].as_py()
        for x in range(len(node)):
            y = np.flatnonzero((label != label[x]) & (node > node[x]) & (True if lone else own != own[x]))
            total = size[y] + size[x]
            apart = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1)
            y = y[(apart * (den + num) <= (den - num) * total) & (np.abs(size[y] - size[x]) * (den + num) <= (den - num) * total)]
            for b in node[y].tolist():
                pair = (int(node[x]), b)
                if pair not in seen:
                    if len(seen) > 50_000:  # only saves repeats; distinct() follows
                        seen.clear()
                    seen.add(pair)
                    yield pair

    def run(batches: Iterator[pa.RecordBatch]):
        held, key, seen = [], None, set()

        def rows(found):
            while part := list(islice(found, PAIRS_AT_ONCE)):
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in part])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("sig", "i", "j"))))
            cuts = [0] + [n for n in range(1, len(keys)) if keys[n] != keys[n - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != key and held:
                    yield from rows(pairs(pa.Table.from_batches(held), seen))
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from rows(pairs(pa.Table.from_batches(held), seen))

    return tasks.mapInArrow(run, "a bigint, b bigint").distinct()


def _set_table(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of the named nodes, from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        for part in _slices(batches):
            by_node = {set_hash(s, 1): s for s in _sets(part, size) if len(s)}
            yield pa.RecordBatch.from_arrays([
                pa.array(list(by_node), pa.int64()),
                pa.array([s.astype(np.int64) for s in by_node.values()], pa.list_(pa.int64()))], names=["node", "shingles"])

    made = docs.select("text").mapInArrow(run, "node bigint, shingles array<bigint>")
    kept = join_small(made, nodes, "node", "left_semi", BROADCAST_NODES)
    return materialise(kept.groupBy("node").agg(F.first("shingles").alias("shingles")))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _groups(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Features of every row, and ``node, group, least`` of every node: its component and its smallest id."""
    feats = materialise(features(docs, size))
    classes = materialise(feats.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("proof").alias("lo"), F.max("proof").alias("hi")))
    if classes.where("lo <> hi").limit(1).count():
        raise ValueError("two different sets of shingles have the same 64-bit hash")
    sized = materialise(feats.where("node is not null").groupBy("node").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("bitmap").alias("bitmap")))
    members = materialise(_members(signatures(docs, size, num, den)))
    stars = _possible(_stars(members), sized, num, den)
    best = stars.groupBy("node").agg(F.max(F.struct("common", "hub")).alias("best"))
    pairs = materialise(best.select(F.col("best.hub").alias("a"), F.col("node").alias("b")))
    links = materialise(_check(pairs, _set_table(docs, _nodes(pairs), size), num, den))
    labels = materialise(connected(links))
    more = materialise(_across(members, labels, sized, num, den))
    links = links.union(_check(more, _set_table(docs, _nodes(more), size), num, den))
    labels = materialise(connected(links))
    named = classes.select("node", F.col("doc_id").alias("least")).join(labels, "node", "left")
    return feats, materialise(named.select("node", F.coalesce("label", "node").alias("group"), "least", F.col("label").isNotNull().alias("linked")))


def components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Two documents link when ``den * intersection >= num * union`` of their
    sets of ``size``-word shingles; ``component_id`` is the smallest ``doc_id``
    reachable by links. A null, empty or blank text has no shingle and is alone.
    Repeated rows are copies of each other. A null ``doc_id`` takes part in
    links but names no component: a component without any id gives null.
    """
    feats, nodes = _groups(docs, size, num, den)
    ids = materialise(nodes.where("linked").groupBy("group").agg(F.min("least").alias("component")))
    named = materialise(nodes.join(ids, "group", "left").select("node", F.coalesce("component", "least").alias("component")))
    return (feats.join(named, "node", "left")
            .select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")))


def representatives(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, unchanged.

    The row with the smallest id stays (one without id only where no row of the
    group has one; the smallest text hash decides between texts of one id).
    Rows without words are in no group and stay. What is removed is usually far
    less than what stays, so the texts are matched with the removed rows.
    """
    feats, nodes = _groups(docs, size, num, den)
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("text_hash").alias("h"))
    rows = materialise(feats.where("node is not null").select("node", key.alias("key"))
                       .groupBy("node", "key").agg(F.count(F.lit(1)).alias("n")).join(nodes.select("node", "group"), "node"))
    first = materialise(rows.groupBy("group").agg(F.min("key").alias("first")))
    judged = rows.join(first, "group").select("key.*", "n", (F.col("key") == F.col("first")).alias("stays")).toDF("__n", "__d", "__h", "__rows", "__stays")
    judged = materialise(judged)
    match = ["__n", "__d", "__h"]
    own = docs.withColumns({"__n": F.col("doc_id").isNull(), "__d": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "__h": F.xxhash64("text")})
    gone = judged.where("not __stays or __rows > 1").select(*match)
    given = [f"`{c}`" for c in docs.columns]
    kept = join_small(own, gone, match, "left_anti").select(*given)
    again = judged.where("__stays and __rows > 1").select(*match)  # rows that repeat a row that stays: one of them
    if not again.limit(1).count():
        return kept
    return kept.unionByName(join_small(own, again, match, "left_semi").dropDuplicates(match).select(*given))
