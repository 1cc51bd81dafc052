"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find.

1. One pass over the texts gives each document the size of its shingle set, a 128-bit class of
   the set and a SuperMinHash signature. Equal sets are one class, which has a number of its own;
   copies are never compared or paired, and rows of one doc_id with different sets are different classes.
2. Banding: classes that share a band meet in a bucket. One aggregation counts buckets and drops
   what is alone; the rest get their signatures. In a bucket, union-find over estimated
   similarities of `margin` below the threshold or more gives a spanning forest: at most one
   edge a member, never all pairs. A bucket of more than `bucket` classes never meets in a task:
   its members are joined to its least one, without an estimate.
3. The components of these edges are candidate clusters: every link that banding finds lies in
   one. Their members' full sets are made again from the texts. A cluster is cut into blocks of at most about
   `block` sets and `room` bytes, and pairs within a block are confirmed on the full sets, where
   their estimate is in reach and verified links don't connect them already.
4. Clusters of more than one block go on: one member of each group found so far is held against the
   others; then those still outside the largest group of their cluster are held against every block. So a set is
   copied as often as there are blocks of outsiders, not of members.
5. Components of the verified links, by distributed star contraction, name the groups.

With 32 bands of 4 a pair at 0.75 is missed with probability 5e-6. With 128 slots an estimate
has a standard error of at most 0.038 at the threshold; the margin is four times that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.graph import components
from gridloom.llm.scratch import Scratch
from gridloom.llm.superminhash import signatures
from gridloom.llm.words import Words, _stream, grams, mix, released, slices, words_of

SHINGLE, THRESHOLD, SLOTS, ROWS, MARGIN, BLOCK, ROOM, BUCKET = 5, 75, 128, 4, 0.16, 4096, 1 << 25, 1024


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and where each begins."""
    n, counts = len(w.hashes), w.counts
    every = grams(w.hashes, k)
    if len(every):
        every = every[np.arange(len(every)) + k <= np.repeat(w.first[1:], counts)[: len(every)]]
    size = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = [grams(w.hashes[w.first[i] : w.first[i + 1]], int(counts[i]))[0] for i in short]
        every = np.insert(every, np.concatenate([[0], np.cumsum(size)])[short], whole)
        size[short] = 1
    first = np.concatenate([[0], np.cumsum(size)])
    every = every.copy()
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo > 1:
            every[lo:hi].sort()
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    new[first[:-1][size > 0]] = True
    return every[new], np.concatenate([[0], np.cumsum(new)])[first]


def _class_of(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((2, len(first)), np.uint64)
    with np.errstate(over="ignore"):
        for i, seed in enumerate((np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ seed))])
            total[i, 1:] = run[first[1:]] - run[first[:-1]]
    return total[0, 1:].view(np.int64), total[1, 1:].view(np.int64)


def _signed(k: int, slots: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                sets, first = shingle_sets(words_of(part.column(1), True), k)
                c1, c2 = _class_of(sets, first)
                sig = signatures(sets, first, slots).astype("<u2")
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * slots), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(first)), pa.array(c1), pa.array(c2), data], ["doc_id", "text_key", "n_shingles", "c1", "c2", "sig"])

    return rows


def _matrix(column, slots: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, slots)


def _keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    packed = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), -1) if rows == 4 else None
    if packed is None:
        packed = np.zeros((len(sig), sig.shape[1] // rows), np.uint64)
        for i in range(rows):
            packed = mix(packed ^ sig[:, i::rows][:, : packed.shape[1]].astype(np.uint64))
    return mix(packed ^ _stream(31, packed.shape[1]))


def _banded(slots: int, rows: int):
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = _keys(_matrix(part.column(1).to_pylist(), slots), rows)
                ids = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "cid"])

    return out


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _forest(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Spanning edges of the graph of rows that agree in `least` slots or more.

    A row is held against one member of each group first, and then only against the groups it
    didn't join, so a large group of near copies costs little more than one comparison a row.
    """
    edges, groups = [], []  # groups: lists of rows
    for x in range(len(sig)):
        joined, rest = None, []
        for g in groups:
            if (sig[g[0]] == sig[x]).sum() >= least:
                hit = g[0]
            else:
                agree = (sig[np.asarray(g)] == sig[x]).sum(axis=1)
                best = int(agree.argmax())
                hit = g[best] if agree[best] >= least else None
            if hit is None:
                rest.append(g)
                continue
            edges.append((hit, x))
            if joined is None:
                joined = g
            else:
                joined.extend(g)
        if joined is None:
            joined = []
        joined.append(x)
        groups = [joined, *rest]
    return edges


def _bucketed(slots: int, least: int):
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges_of(key, cid, sig):
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            two = start[size == 2]
            ok = two[(sig[two] == sig[two + 1]).sum(axis=1) >= least]
            u, v = [cid[ok]], [cid[ok + 1]]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                e = np.asarray(_forest(sig[s : s + n], least), np.int64).reshape(-1, 2) + s
                u.append(cid[e[:, 0]])
                v.append(cid[e[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

        held: list = []  # the bucket that may go on in the next batch
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                key, cid, sig = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2).to_pylist(), slots)
                if held and held[0][0][0] == key[0] == key[-1]:
                    held.append((key, cid, sig))
                    continue
                if held:
                    key, cid, sig = (np.concatenate(x) for x in zip(*held, (key, cid, sig), strict=True))
                cut = int(np.searchsorted(key, key[-1]))
                held = [(key[cut:], cid[cut:], sig[cut:])]
                if cut:
                    yield edges_of(key[:cut], cid[:cut], sig[:cut])
        if held:
            yield edges_of(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return out


def _full_sets(k: int):
    """Classes and full sets (c1, c2, set) of rows (text)."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                sets, first = shingle_sets(words_of(part.column(0), True), k)
                data = pa.array([sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, _class_of(sets, first)), data], ["c1", "c2", "set"])

    return out


def _linked(slots: int, least: int, percent: int):
    """Links (u, v) that verified pairs add to those known by `label`, in a group of rows (cid, side, label, set).

    Within one side every two rows are a pair; of two sides, a row of either.
    """

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "cid"], ignore_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        sig = np.concatenate([signatures(np.concatenate(sets[i : i + 512]), first[i : i + 513] - first[i], slots) for i in range(0, len(sets), 512)]).astype("<u2")
        cid, side = pdf["cid"].to_numpy(), pdf["side"].to_numpy()
        cross = int(np.searchsorted(side, side[-1])) if side[0] != side[-1] else 0
        uf, edges = UnionFind(len(sets)), []
        _, again, known = np.unique(pdf["label"].to_numpy(), return_index=True, return_inverse=True)
        for x, y in enumerate(again[known].tolist()):
            uf.join(x, y)
        for x in range(max(1, cross), len(sets)):
            agree = (sig[: cross or x] == sig[x]).sum(axis=1)
            near = np.flatnonzero(agree >= least)
            for y in near[np.argsort(-agree[near], kind="stable")].tolist():
                if uf.find(x) != uf.find(y):
                    a, b = sets[x], sets[y]
                    both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) else 0
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        uf.join(x, y)
                        edges.append((cid[y], cid[x]))
        return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    return links


def _candidates(classes: DataFrame, scratch: Scratch, slots: int, rows: int, least: int, bucket: int) -> DataFrame:
    """(cid, cluster): candidate clusters of classes (cid, sig)."""
    bands = classes.select("cid", "sig").mapInArrow(released(_banded(slots, rows)), "key long, cid long")
    met = scratch.keep(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("a"), F.max("cid").alias("b")).where("n > 1"), "buckets")
    two = met.where("n = 2").select("key", F.explode(F.array("a", "b")).alias("cid"))
    some = bands.join(met.where((F.col("n") > 2) & (F.col("n") <= bucket)).select("key"), "key").select("key", "cid")
    near = two.union(some).join(classes.select("cid", "sig"), "cid").select("key", "cid", "sig").repartition("key").sortWithinPartitions("key", "cid").mapInArrow(released(_bucketed(slots, least)), "u long, v long")
    hot = bands.join(met.where(F.col("n") > bucket).select("key", "a"), "key").where("cid <> a").select(F.col("a").alias("u"), F.col("cid").alias("v"))
    return scratch.keep(components(near.union(hot), scratch, "candidates").withColumnsRenamed({"node": "cid", "component": "cluster"}), "clusters")


def _cut(rows: DataFrame, block: int, room: int, name: str) -> DataFrame:
    """rows (cluster, cid, n_shingles) with `name`: the number of the cluster's part in which a class lies, by a hash."""
    sizes = rows.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n_shingles") * 8 / room)).cast("int").alias("__parts"))
    placed = rows.join(sizes.where("__parts > 1"), "cluster", "left")
    return placed.withColumn(name, F.coalesce(F.pmod(F.xxhash64("cid", F.lit(name)), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")


def _verified(docs: DataFrame, classes: DataFrame, clusters: DataFrame, scratch: Scratch, shingle: int, link, block: int, room: int) -> DataFrame:
    """Links (u, v) between classes of one cluster; they connect what all links of a cluster would."""
    members = clusters.join(classes.select("cid", "doc", "c1", "c2", "n_shingles"), "cid")
    # texts meet no more than the ids of members, in a table whose size is known, so that a small one is broadcast; which of an id's texts has a member's class is told after
    ids = scratch.keep(members.select("doc").distinct(), "ids")
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(ids, "doc", "left_semi").select("text")
    sets = texts.mapInArrow(released(_full_sets(shingle)), "c1 long, c2 long, set binary").dropDuplicates(["c1", "c2"])
    sets = sets.join(members.select("cid", "c1", "c2"), ["c1", "c2"]).select("cid", "set")
    members = scratch.keep(_cut(members.select("cluster", "cid", "n_shingles"), block, room, "block"), "members")
    of = lambda rows: rows.groupBy("cluster", "meeting").applyInPandas(link, "u long, v long")
    large = members.where("block > 0").select("cluster").distinct()
    if large.isEmpty():
        return of(members.join(sets, "cid").select("cluster", F.col("block").alias("meeting"), "cid", F.lit(0).alias("side"), F.col("cid").alias("label"), "set"))
    sets = scratch.keep(sets, "sets")
    edges = scratch.keep(of(members.join(sets, "cid").select("cluster", F.col("block").alias("meeting"), "cid", F.lit(0).alias("side"), F.col("cid").alias("label"), "set")), "links-0")
    members = members.join(large, "cluster", "left_semi")

    def labelled(name: str) -> DataFrame:
        found = components(edges, scratch, name).withColumnsRenamed({"node": "cid", "component": "label"})
        return scratch.keep(members.join(found, "cid", "left").withColumn("label", F.coalesce("label", "cid")), f"{name}-labels")

    heads = _cut(labelled("blocks").where("cid = label").select("cluster", "cid", "n_shingles"), block, room, "meeting")
    edges = scratch.keep(edges.union(of(heads.join(sets, "cid").select("cluster", "meeting", "cid", F.lit(0).alias("side"), F.col("cid").alias("label"), "set"))), "links-1")
    rows = labelled("heads")
    main = rows.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = _cut(rows.join(main, "cluster").where("label <> main").select("cluster", "cid", "n_shingles", "label"), block, room, "chunk").select("cluster", "cid", "label", "chunk")
    chunks = outside.groupBy("cluster").agg(F.max("chunk").alias("last"))
    blocks = members.groupBy("cluster").agg(F.max("block").alias("last"))
    name = F.concat_ws("-", "block", "chunk").alias("meeting")
    left = rows.join(chunks, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), "last"))).select("cluster", name, "cid", F.lit(0).alias("side"), "label")
    right = outside.join(blocks, "cluster").withColumn("block", F.explode(F.sequence(F.lit(0), "last"))).select("cluster", name, "cid", F.lit(1).alias("side"), "label")
    return edges.union(of(left.union(right).join(sets, "cid").select("cluster", "meeting", "cid", "side", "label", "set")))


def _grouped(docs: DataFrame, scratch: Scratch, shingle: int, percent: int, slots: int, rows: int, margin: float, block: int, room: int, bucket: int) -> DataFrame:
    """doc_id, text_key, n_shingles, label (a number of the group, null without words), component_id of each row."""
    least = int(np.ceil((percent / 100 - margin) * slots))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    signed = scratch.keep(own.mapInArrow(released(_signed(shingle, slots)), "doc_id long, text_key long, n_shingles long, c1 long, c2 long, sig binary"), "signed")
    full = signed.where("doc_id is not null and n_shingles > 0")
    # a class's number depends on how rows were dealt, and its group's name doesn't; it is written, so that it is given once
    classes = full.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    clusters = _candidates(classes, scratch, slots, rows, least, bucket)
    verified = _verified(docs, classes, clusters, scratch, shingle, _linked(slots, least, percent), block, room)
    groups = components(verified, scratch, "verified").withColumnsRenamed({"node": "cid", "component": "label"})
    groups = groups.join(classes.select("cid", "doc"), "cid")
    groups = groups.join(groups.groupBy("label").agg(F.min("doc").alias("group")), "label").select("cid", "label", "group")
    named = classes.select("c1", "c2", "cid", "doc").join(groups, "cid", "left").select("c1", "c2", F.coalesce("label", "cid").alias("label"), F.coalesce("group", "doc").alias("group"))
    out = signed.drop("sig").join(named, ["c1", "c2"], "left")
    real = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select("doc_id", "text_key", "n_shingles", F.when(real, F.col("label")).alias("label"), F.when(real, F.col("group")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, percent: int = THRESHOLD, slots: int = SLOTS, rows: int = ROWS, margin: float = MARGIN, block: int = BLOCK, room: int = ROOM, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Words are runs of characters outside 0x20 and 0x09-0x0D after lower-casing A-Z; a text of
    fewer words than a shingle has one shingle, all of it. Texts whose sets overlap in
    `percent` of their union or more are linked; component_id is the least doc_id reachable.
    Texts that are null or without words have no shingles and are linked with nothing. Rows
    without doc_id have no component and are kept. Rows that share a doc_id are linked if their texts are, each
    has the component of its own text, and all are returned. An empty table gives an empty one.
    """
    out = _grouped(docs, scratch, shingle, percent, slots, rows, margin, block, room, bucket)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, percent: int = THRESHOLD, slots: int = SLOTS, rows: int = ROWS, margin: float = MARGIN, block: int = BLOCK, room: int = ROOM, bucket: int = BUCKET) -> DataFrame:
    """The rows of docs that represent their group, with the columns of docs: one row of each group, that with its least doc_id.

    Of rows of a group that share this doc_id the greatest stays (by the columns in their order, null
    being least), so rows of one doc_id with different texts all stay, each for its own group. A
    row without words stays if no other of its doc_id does, of several the greatest. Rows without doc_id all stay.
    """
    decided = scratch.keep(_grouped(docs, scratch, shingle, percent, slots, rows, margin, block, room, bucket).where("doc_id is not null"), "decided")
    again = scratch.keep(decided.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    # texts meet ids alone, in tables that are written, so that their size is known and a small one is broadcast
    apart = scratch.keep(decided.where("doc_id <> component_id").select("doc_id").union(again).distinct(), "apart")
    once = docs.join(apart, "doc_id", "left_anti").select(*docs.columns)
    labels = decided.join(again, "doc_id", "left_semi").where("doc_id = component_id").groupBy("doc_id", "text_key").agg(F.max("label").alias("__label")).withColumnRenamed("text_key", "__key")
    repeated = docs.join(again, "doc_id", "left_semi").withColumn("__key", F.xxhash64("text"))
    most = repeated.join(labels, ["doc_id", "__key"]).groupBy("doc_id", "__label").agg(F.max(F.struct(*docs.columns)).alias("row"))
    worded = labels.where("__label is not null").select("doc_id").distinct()
    bare = most.where("__label is null").join(worded, "doc_id", "left_anti")
    return once.unionByName(most.where("__label is not null").select("row.*")).unionByName(bare.select("row.*"))
