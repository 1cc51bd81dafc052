"""Quality classifier by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from texts labelled good, one from texts labelled bad. Every text is
compressed in blocks, each with both dictionaries, as within one frame a long text would supply
its own matches and its tail would not be judged. The feature is the difference of the two sums
of compressed sizes over the length of the text; a logistic curve fitted on labelled texts that
no dictionary has seen makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.sampling import bounded, held_out
from gridloom.llm.words import released, slices, text_bytes

#: Most labelled documents of the rarer label that training takes, most bytes of one of them, and bytes of a dictionary.
SAMPLE, MOST, DICTIONARY, LEVEL, CUT = 2000, 1 << 16, 96 * 1024, 3, 0.7
#: Bytes of a text that are compressed by themselves, the last block of a text may have fewer; of a training sample; least bytes of a dictionary.
BLOCK, PIECE, LEAST = 4096, 512, 256


class CompressionModel:
    def __init__(self, good: bytes, bad: bytes, weights: tuple[float, float] = (0.0, 0.0), level: int = LEVEL):
        self.good, self.bad, self.weights, self.level = good, bad, weights, level
        self._made = None

    def __getstate__(self):
        return self.good, self.bad, self.weights, self.level

    def __setstate__(self, state):
        self.good, self.bad, self.weights, self.level = state
        self._made = None

    def feature(self, data: bytes) -> float:
        """Compressed size of all blocks with the bad dictionary less that with the good one, over the size of the text; 0 if empty."""
        if not data:
            return 0.0
        if self._made is None:
            made = []
            for content in (self.good, self.bad):
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT) if content else None
                if held is not None:
                    held.precompute_compress(level=self.level)
                made.append(zstandard.ZstdCompressor(level=self.level, dict_data=held) if held is not None else zstandard.ZstdCompressor(level=self.level))
            self._made = made
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        good, bad = (sum(len(z.compress(b)) for b in blocks) for z in self._made)
        return (bad - good) / (len(data) + 64)

    def score(self, feature: np.ndarray) -> np.ndarray:
        slope, base = self.weights
        return 1 / (1 + np.exp(-np.clip(slope * feature + base, -50, 50)))


def dictionaries(good: list[bytes], bad: list[bytes], size: int) -> tuple[bytes, bytes]:
    """A trained dictionary of each label's texts, both of at most the same size: `size` bytes, or an eighth of the scarcer label's text.

    Where the texts of either label don't make a dictionary (too few of them, or nothing in them
    that repeats), neither has one: both are empty, and no text is told from another.
    """
    pieces = [[t[i : i + PIECE] for t in own for i in range(0, len(t), PIECE)] for own in (good, bad)]
    size = min(size, min(sum(map(len, own)) for own in pieces) // 8)
    if size < LEAST or min(map(len, pieces)) < 8:
        return b"", b""
    try:
        return tuple(zstandard.train_dictionary(size, own, level=LEVEL).as_bytes() for own in pieces)
    except zstandard.ZstdError:
        return b"", b""


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and base of a logistic curve, by Newton steps."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(texts: list[bytes], labels: np.ndarray, size: int = DICTIONARY) -> CompressionModel:
    """Dictionaries from two of every three texts, the curve from the third. Without dictionaries every text has the share of label 1."""
    order = np.arange(len(texts))
    built = order % 3 != 0
    model = CompressionModel(*dictionaries(*([texts[i] for i in order[built & (labels == want)]] for want in (1, 0)), size))
    rest = order[~built]
    share = labels.mean() if len(labels) else 0.5
    model.weights = (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if model.good and len(set(labels[rest].tolist())) == 2:
        model.weights = logistic(np.array([model.feature(texts[i]) for i in rest]), labels[rest].astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST) -> CompressionModel:
    """Learns from labels.quality (0 or 1) of rows that are not held out. A document labelled twice counts once, with its least label.

    `sample` bounds the rows of the rarer label; the other is sampled at the same rate, so that
    the curve sees the labels in their own proportions. Texts of more than `most` bytes are not in
    the sample, so that what the driver gathers has a bound; they are judged whole like any other.
    """
    own = labels.where(F.col("quality").isin(0, 1) & ~held_out(4, 2) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r[0]: r[1] for r in own.groupBy("quality").count().collect()}
    rate = min(1.0, sample / max(1, min(counts.values(), default=1)), 5 * sample / max(1, sum(counts.values())))
    ids = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < rate)
    # at most about 5 * sample ids, whatever the size of the tables
    got = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most).join(F.broadcast(ids), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit([x.encode() for x in got.column("text").to_pylist()], np.asarray(got.column("quality").to_pylist(), np.int64))


def classify(docs: DataFrame, model: CompressionModel, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null or empty text has the score of no difference.

    Only the text is read. Rows that repeat a doc_id are scored each; a null doc_id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column(2))
                data = memoryview(data)
                feature = np.array([shared.value.feature(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                score = shared.value.score(feature)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(4, 2).alias("held_out"), "text").mapInArrow(released(rows), "doc_id long, held_out boolean, score double, predicted int")
