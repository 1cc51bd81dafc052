"""Scores whole documents by a gated recurrent language model, beside an exact unigram baseline.

1. Words of all training documents are counted (one aggregation over 64-bit word hashes).
2. The `HEAD` most frequent words go to every executor with their counts, a table of fixed size.
   The most frequent of them are the vocabulary of the recurrent model; all other words are its
   last class, within which a word has the probability of its smoothed count.
3. The model starts, on the driver, by truncated backpropagation over about `SAMPLE` training documents
   of up to `MOST` bytes.
4. From there it learns from all training documents, whole, in rounds. In a round every task goes on
   from the model of the round before, through all the rows it reads, `CHUNK` tokens at a time;
   the mean of their weights, by tokens, is the model. Each round has as many tokens as all
   before it, so their number grows with the corpus; the driver gets at most `FAN` models a round.
5. One pass scores each whole text, state carried to its end. Words beyond the head leave as
   (word, times) and meet their counts in a join; one aggregation sums up each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.gru import CLASSES, SIZE, GatedModel
from gridloom.llm.sampling import held_out
from gridloom.llm.scratch import Scratch
from gridloom.llm.words import released, slices, words_of

#: Words whose counts are broadcast (12 bytes each); documents the recurrent model starts from, and most bytes of one of them.
HEAD, SAMPLE, MOST, PASS = 1 << 18, 1200, 1 << 16, 1 << 24
#: Least tokens of the first round, tokens and rate of one run of a task, models averaged in one task.
ROUND, CHUNK, RATE, FAN = 1 << 22, 1 << 19, 0.003, 64
#: The end token's key; no word has it but by a chance of 2**-64.
END = np.uint64(0x9D5C0F1B2A3E4D67)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts, each text's followed by END, and where each text begins."""
    w = words_of(column, True)
    return np.insert(w.hashes, w.first[1:], END), w.first + np.arange(len(w.first))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def made():
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])

    for batch in batches:
        for part in slices(batch):
            new, n = np.unique(_tokens(part.column(0))[0], return_counts=True)
            both = np.concatenate([keys, new])
            keys, nth = np.unique(both, return_inverse=True)
            counts = np.bincount(nth, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > 1 << 20:
                yield made()
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(keys):
        yield made()


class WordTable:
    """Head words by key: rank (by count, then key) and count. An index over the leading bits of keys, which are hashes, says where to look."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((keys, -counts))] = np.arange(len(keys))
        self.keys, self.counts, self.rank = keys[order], counts[order], rank[order]
        bits = max(1, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table of each key, and whether it is there."""
        n = len(self.keys)
        if not n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(self.first[keys >> self.shift], n - 1)
        there = self.keys[at] == keys
        rest = np.flatnonzero(self.keys[at] < keys)
        while len(rest):
            at[rest] += 1
            rest = rest[at[rest] < n]
            now = self.keys[at[rest]]
            there[rest[now == keys[rest]]] = True
            rest = rest[now < keys[rest]]
        return np.minimum(at, n - 1), there


def _ids(table: WordTable, keys: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, there = table.find(keys)
    rank = np.where(there, table.rank[at] if len(table.rank) else 0, known)
    return np.minimum(rank, known), at, there


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the mean of weights (n long, p binary) by n, and the sum of n."""
    total, n = 0.0, 0
    for batch in batches:
        for k, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total, n = total + k * np.frombuffer(p.as_buffer(), "<f4").astype(np.float64), n + k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], ["n", "p"])


def refine(encoded: DataFrame, model: GatedModel, scratch: Scratch, chunk: int = CHUNK, rate: float = RATE, fan: int = FAN) -> None:
    """Goes on training `model` in every task that holds rows of encoded (ids binary), and takes the mean of their weights.

    A task learns from all its rows, each run of `chunk` tokens from the weights of the last. Without rows the model stays as it is. Means are formed in rounds of `fan` models a task, so
    neither a task nor the driver gathers more than that; each round is kept in the shared folder.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, have, n, own = [], 0, 0, shared.value.copy()
        for batch in batches:
            for row in batch.column(0):
                texts.append(np.frombuffer(row.as_buffer(), "<u4").astype(np.int64))
                have += len(texts[-1])
                if have >= chunk:
                    own.train(texts, epochs=1, rate=rate)
                    texts, have, n = [], 0, n + have
        if have:
            own.train(texts, epochs=1, rate=rate)
        if n + have:
            yield pa.RecordBatch.from_arrays([pa.array([n + have]), pa.array([own.flat().astype("<f4").tobytes()], pa.binary())], ["n", "p"])

    rows, k = scratch.keep(encoded.select("ids").mapInArrow(released(learn), "n long, p binary"), "refined-0"), 0
    count = rows.count()
    while count > fan:
        k, count = k + 1, -(-count // fan)
        rows = scratch.keep(rows.repartition(count).mapInArrow(released(_mean), "n long, p binary"), f"refined-{k}")
    last = list(_mean(iter(rows.orderBy("n", "p").toArrow().to_batches())))
    if last:
        model.set_flat(np.frombuffer(last[0].column(1)[0].as_buffer(), "<f4"))


def score_documents(docs: DataFrame, scratch: Scratch, head: int = HEAD, sample: int = SAMPLE, classes: int = CLASSES, size: int = SIZE, epochs: int = 2, first: int = ROUND) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens: after lower-casing A-Z, runs of characters outside 0x20 and 0x09-0x0D, then one end.
    A null or empty text is the end alone. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1)));
    score is the recurrent model's log10 probability of the text. Training documents are those
    whose crc32 of doc_id modulo 5 is not 1 (a null doc_id trains). Rows that repeat a doc_id are
    scored each. With no training documents every token has the one smoothed count; an empty
    table gives no rows.
    """
    spark, known = docs.sparkSession, classes * size
    training = docs.where(~held_out(5, 1))
    counts = scratch.keep(training.select("text").mapInArrow(released(_counted), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(head).toArrow()
    table = WordTable(top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy())
    ranked = np.sort(table.counts)[::-1]
    model = GatedModel(ranked[:known], float(n_all - ranked[:known].sum()), classes, size)
    below = float(np.log10(n_all + 0.5 * (v_all + 1)))
    rest = float(np.log10(n_all - ranked[:known].sum() + 0.5 * (v_all - min(v_all, known) + 1)))
    shared = spark.sparkContext.broadcast(table)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, first = _tokens(part.column(1))
                ids = _ids(shared.value, keys, known)[0].astype("<u4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["doc_id", "ids"])

    rows = training.select("doc_id", "text").where("doc_id is not null")
    rate = min(1.0, sample / max(1, rows.count()))
    some = rows.where(F.octet_length("text") <= MOST).where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < int(rate * (1 << 30))).mapInArrow(released(encoded), "doc_id long, ids binary").toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending")])
    texts = [np.frombuffer(x, "<u4").astype(np.int64) for x in some.column("ids").to_pylist()]
    model.train([texts[i] for i in np.random.default_rng(0).permutation(len(texts))], epochs=epochs)
    # a null doc_id trains too; ids are kept, so that texts are split once for all rounds
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)).alias("doc_id")
    every = scratch.keep(training.select(place, "text").mapInArrow(released(encoded), "doc_id long, ids binary"), "encoded")
    edges = [0, *(1 << max(0, 30 - k) for k in range(max(0, (n_all // first).bit_length() - 1), -1, -1))]
    for a, b in pairwise(edges):
        refine(every.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)), model, scratch)
    scratch.drop("encoded")
    learned = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, seen = TaskContext.get(), 0
        row0 = (context.partitionId() if context else 0) << 33
        names = ["row", "doc_id", "held_out", "word", "times", "n_tokens", "n_known", "base", "score"]
        for batch in batches:
            for part in slices(batch, PASS):
                n = part.num_rows
                keys, first = _tokens(part.column(2))
                ids, at, there = _ids(shared.value, keys, known)
                owner = np.repeat(np.arange(n), np.diff(first))
                natural = learned.value.score([ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)])
                weight = np.log10((shared.value.counts[at] if len(shared.value.counts) else np.zeros(len(at))) + 0.5)
                base = np.bincount(owner, np.where(there, weight, 0.0) - below, n)
                extra = np.bincount(owner, np.where(ids == known, np.where(there, weight, 0.0) - rest, 0.0), n)
                far = np.flatnonzero(~there)
                rows = row0 + seen + np.arange(n)
                nulls = pa.nulls(len(far), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows), part.column(0), part.column(1), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int64)), pa.array(np.diff(first)), pa.array(np.bincount(owner, there, n).astype(np.int64)), pa.array(base), pa.array(natural / np.log(10) + extra)], names)
                if len(far):
                    pair = np.rec.fromarrays([owner[far], keys[far]], names="o,k")
                    pair, times = np.unique(pair, return_counts=True)
                    nulls = pa.nulls(len(pair), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(rows[pair.o]), nulls, pa.nulls(len(pair), pa.bool_()), pa.array(pair.k.view(np.int64)), pa.array(times), nulls, nulls, pa.nulls(len(pair), pa.float64()), pa.nulls(len(pair), pa.float64())], names)
                seen += n

    parts = docs.select("doc_id", held_out(5, 1).alias("held_out"), "text").mapInArrow(released(scored), "row long, doc_id long, held_out boolean, word long, times long, n_tokens long, n_known long, base double, score double")
    # rows of documents carry no word; a key of their own keeps them from meeting in one task
    parts = parts.withColumn("key", F.coalesce("word", F.xxhash64("row")))
    met = parts.join(counts.select(F.col("word").alias("key"), "n"), "key", "left").withColumn("n", F.when(F.col("word").isNotNull(), F.coalesce("n", F.lit(0))))
    far = F.col("times") * F.log10(F.col("n") + 0.5)
    sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("times"))), F.lit(0))).alias("n_known"), (F.max("base") + F.coalesce(F.sum(far), F.lit(0.0))).alias("base_score"), (F.max("score") + F.coalesce(F.sum(far), F.lit(0.0))).alias("score"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")
