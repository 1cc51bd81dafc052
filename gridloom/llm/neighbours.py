"""Approximate nearest neighbours: a forest of random-projection trees searched through one priority queue.

Trees are fitted on a bounded sample and every row is put into a leaf of each tree. A query takes
leaves from a queue shared by all trees, least sum of squared distances beyond splitting planes
first, until it has visited as many as `share` says, and as many as there are trees at least; the rows of these leaves are ranked by the exact cosine of the original vectors.
The trees have at most 2 ** levels leaves, which bounds the copies of a query but not the rows it
scores: with `share` 1 these are, repeats included, as many as the table has, so the work is
queries times rows. Vectors with more structure need a smaller share and more levels.
A leaf with more rows than `part` is cut into parts that all its queries visit, so no task gathers an
unbounded leaf, and every part returns its k best for each query, ties to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch

TREES, LEAF, SAMPLE, PART, SHARE, DEPTH = 12, 128, 16_384, 4096, 1.0, 6


class Forest:
    """Complete trees of one depth; node i has children 2i+1 and 2i+2. x goes right where x @ normal > offset."""

    def __init__(self, x: np.ndarray, trees: int, depth: int, seed: int = 0):
        rng, inner = np.random.default_rng(seed), (1 << depth) - 1
        self.depth, self.trees = depth, trees
        self.normals = np.zeros((trees, inner, x.shape[1]), np.float32)
        self.offsets = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            rows = {0: np.arange(len(x))}
            for node in range(inner):
                own = rows.pop(node)
                a = rng.standard_normal(x.shape[1])
                if len(own) > 1:
                    i, j = rng.choice(own, 2, replace=False)
                    if np.any(x[i] != x[j]):
                        a = x[i] - x[j]
                a = a / (np.linalg.norm(a) or 1.0)
                side = x[own] @ a
                cut = float(np.median(side)) if len(own) else 0.0
                self.normals[t, node], self.offsets[t, node] = a, cut
                rows[2 * node + 1], rows[2 * node + 2] = own[side <= cut], own[side > cut]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, (rows, trees)."""
        out = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.normals[t, node]) > self.offsets[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, q: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that a query visits, in the order of the shared queue."""
        margin = self.normals @ q - self.offsets
        first, out = (1 << self.depth) - 1, []
        queue = [(0.0, t, 0) for t in range(self.trees)]
        while queue and len(out) < visits:
            far, t, node = heapq.heappop(queue)
            while node < first:
                m = float(margin[t, node])
                near, other = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (far + m * m, t, other))
                node = near
            out.append((t, node - first))
        return out


def _usable(vector: Column) -> Column:
    """Not null, without null, NaN or infinite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return raw, (raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))).astype(np.float32)


def _best(k: int):
    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v, ids = np.stack(left["embedding"]).astype(np.float64), left["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        v, ids = v[order], ids[order]
        norm = np.sqrt((v * v).sum(axis=1))
        out = []
        for qid, q in zip(right["query_id"].tolist(), right["query"], strict=True):
            q = np.asarray(q, np.float64)
            score = (v * q).sum(axis=1) / (norm * np.sqrt((q * q).sum()))
            own = np.flatnonzero(ids != qid)
            top = own[np.argsort(-score[own], kind="stable")[:k]]
            out.append((np.full(len(top), qid), ids[top], score[top]))
        return pd.DataFrame({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return rank


def nearest(rows: DataFrame, is_query: Column, scratch: Scratch, k: int = 5, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, share: float = SHARE, part: int = PART, levels: int = DEPTH) -> DataFrame:
    """The k nearest found of every query, by cosine: query_id, rank, vec_id, score.

    Queries are the rows where is_query holds; candidates are all rows but the query's own id.
    Vectors that are null, zero, or hold nulls, NaN or infinities take no part. Vectors of
    different lengths are never compared: each length has a forest of its own. A query visits `share` times as
    many leaves as one tree has, and as many as there are trees at least. Rows that share a vec_id are one candidate and one query: the score of two ids is
    that of their nearest vectors. With fewer than k candidates all are returned; an empty table gives no rows.
    """
    good = rows.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).withColumn("embedding", F.col("embedding").cast("array<double>"))
    spark = rows.sparkSession
    out = None
    for dim, n in sorted((r[0], r[1]) for r in good.groupBy(F.size("embedding")).count().collect()):
        own = good.where(F.size("embedding") == dim)
        some = own.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))).select("vec_id", "embedding").toArrow().sort_by("vec_id")
        depth = max(0, min(levels, int(np.floor(np.log2(max(1, n / leaf))))))
        x = _unit(some.column("embedding").combine_chunks())[1] if some.num_rows else np.ones((1, dim), np.float32)
        forest = spark.sparkContext.broadcast(Forest(x, trees if depth else 1, depth))
        visits = max(trees, int(np.ceil(share * (1 << depth))))

        def seat(batches: Iterator[pa.RecordBatch], forest=forest) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    b = batch.slice(at, 2048)
                    leaves = forest.value.leaves(_unit(b.column(1))[1])
                    for t in range(leaves.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(leaves[:, t]), b.column(0), b.column(1)], ["tree", "leaf", "vec_id", "embedding"])

        def ask(batches: Iterator[pa.RecordBatch], forest=forest, visits=visits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    b = batch.slice(at, 64)
                    seen = [forest.value.search(q, visits) for q in _unit(b.column(1))[1]]
                    nth = np.repeat(np.arange(len(seen)), [len(s) for s in seen])
                    flat = np.array([p for s in seen for p in s], np.int32).reshape(-1, 2)
                    take = pa.array(nth)
                    yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy()), b.column(0).take(take), b.column(1).take(take)], ["tree", "leaf", "query_id", "query"])

        seated = own.select("vec_id", "embedding").mapInArrow(seat, "tree int, leaf int, vec_id long, embedding array<double>")
        parts = seated.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
        cut = F.broadcast(scratch.keep(parts.where("parts > 1"), f"parts-{dim}"))  # at most trees * 2 ** DEPTH rows
        seated = seated.join(cut, ["tree", "leaf"], "left").withColumn("part", F.pmod("vec_id", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        asked = own.where("asks").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).distinct().mapInArrow(ask, "tree int, leaf int, query_id long, query array<double>")
        asked = asked.join(cut, ["tree", "leaf"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        keys = ["tree", "leaf", "part"]
        found = seated.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_best(k), "query_id long, vec_id long, score double")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
