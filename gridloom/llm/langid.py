"""Language ID by hierarchical discrimination: the family first, then the language within it.

Features are relative frequencies of byte trigrams of the whole text, hashed to `BUCKETS` and
scaled. One-versus-rest linear support vector machines choose the family; within a family,
one-versus-one machines separate its languages and their margins are added up. A linear score
of frequencies is a mean of per-trigram weights, so a document costs one table look-up a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.sampling import bounded, held_out
from gridloom.llm.words import _LOWER, released, slices, text_bytes

BUCKETS = 1 << 12
#: Most labelled documents of a language that training takes; the features are of their whole texts.
SAMPLE = 1000
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic"}
UNDETERMINED = "und"


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram of data, which is framed by a space on either side."""
    x = np.empty(len(data) + 2, np.uint32)
    x[0] = x[-1] = 32
    x[1:-1] = _LOWER[data]
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(part.column(1))
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                n = np.bincount(trigrams(data[a:b]), minlength=BUCKETS)
                at = np.flatnonzero(n)
                rows.append((at.astype("<u2").tobytes(), (n[at] / max(1, b - a)).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "at", "value"])


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with hinge loss, by dual coordinate descent; y is -1 or 1."""
    n, rng = len(x), np.random.default_rng(0)
    w, bias, a = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(n)
    cost = c * n / (2 * np.maximum(1, np.where(y > 0, (y > 0).sum(), (y < 0).sum())))
    q = (x * x).sum(axis=1) + 1
    for _ in range(epochs):
        for i in rng.permutation(n):
            g = y[i] * (w @ x[i] + bias) - 1
            new = min(max(a[i] - g / q[i], 0.0), cost[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w += np.float32(step) * x[i]
                bias += step
                a[i] = new
    return np.append(w, bias)


class LanguageModel:
    """machines: (what, winner, loser, weights); what is '' for families, or the family. A loser of None stands for the rest."""

    def __init__(self, families: dict[str, list[str]], machines: list[tuple[str, str, str | None, np.ndarray]]):
        self.families, self.machines = families, machines
        self.table = np.ascontiguousarray(np.array([m[3][:-1] for m in machines], np.float32).reshape(-1, BUCKETS).T)
        self.bias = np.array([m[3][-1] for m in machines], np.float32)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = text_bytes(column)
        score = np.zeros((len(column), len(self.machines)), np.float32)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            total = np.zeros(len(self.machines))
            for at in range(a, b, 1 << 18):  # slabs keep a very long text small; two bytes overlap
                seen = trigrams(data[max(a, at - 1) : min(b, at + (1 << 18) + 1)])
                seen = seen[(1 if at > a else 0) : (len(seen) - 1 if at + (1 << 18) < b else len(seen))]
                total += np.bincount(seen, minlength=BUCKETS).astype(np.float32) @ self.table
            score[i] = total / max(1, b - a) + self.bias
        n = len(column)

        def best(what: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            votes = np.zeros((n, len(names)), np.float32)
            for k, (kind, win, lose, _) in enumerate(self.machines):
                if kind == what:
                    votes[:, names.index(win)] += score[:, k]
                    if lose is not None:
                        votes[:, names.index(lose)] -= score[:, k]
            order = np.sort(votes, axis=1)
            gap = order[:, -1] - order[:, -2] if len(names) > 1 else np.full(n, 8.0)
            return votes.argmax(axis=1), 1 / (1 + np.exp(-np.clip(gap, 0, 30)))

        kinds = sorted(self.families)
        family, sure = best("", kinds)
        out, value = np.empty(n, object), np.zeros(n)
        for f, name in enumerate(kinds):
            lang, within = best(name, self.families[name])
            own = family == f
            out[own] = np.array(self.families[name], object)[lang[own]]
            value[own] = (sure * within)[own]
        return out.tolist(), value


def train(docs: DataFrame, sample: int = SAMPLE, families: dict[str, str] | None = None) -> LanguageModel | None:
    """Learns from text and lang of rows that are not held out and have both; None if there are none."""
    rows = docs.where(~held_out(3, 1) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    got = bounded(rows, "lang", sample).select("lang", "text").mapInArrow(released(_features), "lang string, at binary, value binary").toArrow()
    if not got.num_rows:
        return None
    order = np.lexsort((np.array([hashlib.md5(v.as_py()).hexdigest() for v in got.column("value")]), np.array(got.column("lang").to_pylist())))  # training sees rows in one order
    langs = np.array(got.column("lang").to_pylist(), object)[order]
    x = np.zeros((len(langs), BUCKETS), np.float32)
    for i, k in enumerate(order.tolist()):
        x[i, np.frombuffer(got.column("at")[k].as_py(), "<u2")] = np.frombuffer(got.column("value")[k].as_py(), "<f4")
    scale = 1 / (x.std(axis=0) + 1e-4) / 8
    x *= scale
    kinship = FAMILIES if families is None else families
    of = np.array([kinship.get(v, v) for v in langs], object)
    kinds = {f: sorted(set(langs[of == f])) for f in sorted(set(of))}
    machines = []
    names = sorted(kinds)
    for f in names if len(names) > 2 else names[:1] if len(names) == 2 else []:
        w = fit_svm(x, np.where(of == f, 1.0, -1.0))
        machines.append(("", f, None if len(names) > 2 else names[1], np.append(w[:-1] * scale, w[-1])))
    for f, own in kinds.items():
        for a, b in combinations(own, 2):
            at = np.flatnonzero((langs == a) | (langs == b))
            w = fit_svm(x[at], np.where(langs[at] == a, 1.0, -1.0))
            machines.append((f, a, b, np.append(w[:-1] * scale, w[-1])))
    return LanguageModel(kinds, machines)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    lang_pred is a learned language, or `und` with score 0 where the text is null, has no letter,
    or nothing was learned. Columns lang and source are never read here. Rows that repeat a
    doc_id are scored each; a null doc_id is returned as null and not held out.
    """
    rows = docs.select("doc_id", held_out(3, 1).alias("held_out"), "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                letters = part.column(3).to_numpy(zero_copy_only=False)
                lang, value = shared.value.predict(part.column(2)) if shared.value else ([], letters)
                lang = [p if ok else UNDETERMINED for p, ok in zip(lang or [UNDETERMINED] * len(letters), letters, strict=True)]
                value = np.where(letters & bool(shared.value), value, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(value.astype(float))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(released(score), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of docs whose text has a language: those that identify() calls `und` go.

    These are, by the definition of `und`, texts without a letter; a model predicts some language for any other, and no clean
    document is to go for a language that is little sure. Where nothing was learned (model is None), every text that has a letter stays.
    """
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    if model is None:
        return docs.where(letters)
    rows = docs.withColumn("__letters", letters)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                letters = part.column(part.num_columns - 1)
                lang, _ = shared.value.predict(part.column(at))
                ok = pa.array([p != UNDETERMINED and bool(x) for p, x in zip(lang, letters.to_pylist(), strict=True)])
                yield part.select(range(part.num_columns - 1)).filter(ok)

    return rows.mapInArrow(released(keep), docs.schema)
