import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from gridloom.llm import langid, lm_scoring, neighbours, packing, quality
from gridloom.llm.gru import GatedModel
from gridloom.llm.scratch import Scratch
from tests.llm.helpers import SCHEMA, clashing, corpus, fold, words

SF = "/root/testdata/sf0.01"


def test_packing_keeps_every_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["İ, Ünï's don't A.B 12ab İ.", "ﬁ, é, ́x ß. Straße! ΑΣ, ΣΑΣ. 漢字 it's. 's 't", "ª. º, µ! x\xa0y\x85z \x1cq naïve... -- (hi) \"É\" ÀÉ."]
    docs = corpus(spark, extra=[(2000 + i, t, None, None, None) for i, t in enumerate(odd)] + [(None, "a", None, None, None)])
    text = {r.doc_id: r.text for r in docs.collect()}
    got = packing.pack(clashing(docs)).toPandas()
    for doc_id, pieces in got[got.doc_id.notna()].groupby("doc_id"):
        ids = np.array([*tokenizer.encode(text[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = pieces.sort_values("start")
        assert pieces.length.sum() == len(ids) == pieces.doc_tokens.iloc[0]
        for a, n, c in zip(pieces.start, pieces.length, pieces.ids_crc32, strict=True):
            assert zlib.crc32(ids[a : a + n].tobytes()) == c
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 400)
    where, offset, count = packing.best_fit_decreasing(lengths, 64)
    room = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
        if not fits:
            room.append(64)
            fits = [(64, len(room) - 1)]
        least = min(fits)[0]
        room[fits[[f[0] for f in fits].index(least)][1]] -= lengths[i]
    assert count == len(room) and sorted(np.bincount(where, lengths)) == sorted(64 - np.array(room))
    assert (offset + lengths <= 64).all()


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, sample=300)
    assert set(model.families) == {"germanic", "romance"} and len(model.machines) == 3
    rows = [(9001, None, "en", None, 0), (9002, "12 !! ...", "en", None, 0), (9003, "", "en", None, 0), (None, "la que los de ción", "xx", None, 0)]
    more = docs.union(spark.createDataFrame(rows, docs.schema))
    got = langid.identify(clashing(more), model).toPandas()
    assert set(got.lang_pred[got.doc_id.isin([9001, 9002, 9003])]) == {"und"} and got.score.between(0, 1).all()
    both = got.merge(docs.toPandas()[["doc_id", "lang"]], on="doc_id")
    assert (both.lang == both.lang_pred)[both.held_out].mean() > 0.98
    assert (both.held_out == [fold(int(i), 3) == 1 for i in both.doc_id]).all()
    kept = langid.keep_identified(more, model).toPandas()
    assert len(kept) == len(got) - 3 and kept.columns.tolist() == docs.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.train(empty) is None and set(langid.identify(docs, None).toPandas().lang_pred) == {"und"}


def test_texts_with_letters_stay_where_no_language_is_given(spark):
    import corpus_pipeline

    rows = [(i, t, None, None, 0) for i, t in enumerate(["a b", "é", "漢字 12", "12 !!", "", None])]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in langid.keep_identified(docs, None).collect()) == [0, 1, 2]
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [0, 1, 2]


def test_long_texts_are_scored_whole():
    model = langid.LanguageModel({"a": ["x"], "b": ["y"]}, [("", "a", "b", np.random.default_rng(0).normal(size=langid.BUCKETS + 1))])
    text = "".join(np.random.default_rng(1).choice(list("abc défg"), 300_000))
    seen = np.bincount(langid.trigrams(np.frombuffer(text.encode(), np.uint8)), minlength=langid.BUCKETS)
    gap = abs(2 * (seen @ model.machines[0][3][:-1] / len(text.encode()) + model.machines[0][3][-1]))
    assert math.isclose(model.predict(pa.array([text]))[1][0], 1 / (1 + math.exp(-gap)) / (1 + math.exp(-8)), rel_tol=1e-4)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    more = docs.union(spark.createDataFrame([(9001, None, None, None, 0), (9002, "", None, None, 0), (None, "a", None, None, 0)], docs.schema))
    got = quality.classify(clashing(more), model).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all() and len(got) == docs.count() + 3
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    rank = held.score.rank()
    good = held.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.85
    nothing = quality.train(docs, labels.limit(0))
    assert quality.classify(docs, nothing).toPandas().score.between(0, 1).all()


def test_both_labels_have_trained_dictionaries(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        model = quality.train(*(spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels")))
        for made in (model.good, model.bad):
            assert zstandard.get_frame_parameters(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(made)).compress(b"a")).dict_id
            assert made[:4] == bytes.fromhex("37a430ec") and len(made) <= quality.DICTIONARY
    text = [b"some words again and again " * 20] * 40
    for good, bad in ((text, text[:1]), (text, []), ([], []), (text, [b"", b""] * 40), (text, [b"a"] * 50)):
        assert quality.dictionaries(good, bad, 1 << 16) == (b"", b"")


def test_scores_are_those_of_block_sizes(spark):
    """Every score against one made from sizes of single blocks, and the curve against a search over slopes and bases."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.union(spark.createDataFrame([(9001, None, None, None, 0), (9002, "", None, None, 0), (9003, "word " * 40_000, None, None, 0), (9003, "x", None, None, 0), (9003, "x", None, None, 0)], docs.schema)).select("doc_id", "text").toPandas()
    model = quality.train(docs, labels)

    def feature(text):
        data, sizes = (text or "").encode(), []
        for made in (model.bad, model.good):
            press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(made))
            sizes.append(sum(len(press.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)))
        return (sizes[0] - sizes[1]) / (len(data) + 64) if data else 0.0

    slope, base = model.weights
    want = sorted((int(k), round(1 / (1 + math.exp(-(slope * feature(t) + base))), 5)) for k, t in zip(rows.doc_id, rows.text, strict=True))
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-3 for a, b in zip(want, sorted((r.doc_id, r.score) for r in got), strict=True))
    assert quality.classify(docs.limit(0), model).count() == 0
    x, y = np.random.default_rng(0).normal(size=200), np.random.default_rng(1).integers(0, 2, 200)
    x += y
    loss = lambda s, b: np.log(1 + np.exp(-(2 * y - 1) * (s * x + b))).sum()
    s, b = quality.logistic(x, y.astype(float))
    assert all(loss(s, b) <= loss(s + i * 0.05, b + j * 0.05) + 1e-3 for i in (-1, 0, 1) for j in (-1, 0, 1))


def test_quality_judges_long_texts_to_their_end(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    both = docs.join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id").where("length(text) > 200").select("doc_id", "text", "quality").toPandas().sort_values("doc_id")
    texts = {want: [t.encode() for i, t, q in zip(both.doc_id, both.text, both.quality, strict=True) if fold(i, 4) == 2 and q == want] for want in (0, 1)}
    long = {want: b"\n".join(own * (1 + 500_000 // sum(map(len, own)))) for want, own in texts.items()}
    short, whole = ([model.feature(t[:n]) for t in long.values()] for n in (30_000, None))
    assert all(0.5 < b / a < 2 for a, b in zip(short, whole, strict=True))
    bad, good = model.score(np.array([model.feature(long[want]) for want in (0, 1)]))
    assert bad < quality.CUT <= good
    block = texts[0][0][:4096]
    block = (block * (1 + 4096 // len(block)))[:4096]
    assert math.isclose(model.feature(block * 100), model.feature(block), rel_tol=0.02)


def unigram(docs):
    tokens = {r.doc_id: [*[w.lower() for w in words(r.text)], None] for r in docs.collect()}
    counts = Counter(t for k, ts in tokens.items() if fold(k, 5) != 1 for t in ts)
    n, v = sum(counts.values()), len(counts)
    return {k: (len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for k, ts in tokens.items()}


@pytest.mark.parametrize("head", [1 << 18, 100])
def test_lm_counts_and_base_are_exact(spark, head):
    docs = corpus(spark, extra=[(5000, "ABC abc aBc", None, None, 0)])
    want = unigram(docs)
    got = lm_scoring.score_documents(clashing(docs), Scratch(spark, "t"), head=head, classes=4, size=8, epochs=1).collect()
    assert len(got) == len(want)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, fold(r.doc_id, 5) == 1)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score < 0
    assert lm_scoring.score_documents(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_lm_beats_the_baseline_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lm_scoring.score_documents(docs, Scratch(spark, "t")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() * 0.97


def test_refined_weights_are_the_mean_over_tasks(spark):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 17, n).astype("<u4") for n in (40, 7, 1, 300, 25, 90)]
    table = pa.table({"part": pa.array(range(6), pa.int32()), "ids": pa.array([t.tobytes() for t in texts], pa.binary())})
    rows = spark.createDataFrame(table).repartition(6, "part").select("ids")
    parts = [r.all for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("ids").alias("all")).collect()]
    start, model = (GatedModel(np.ones(16), 1.0, 4, 4) for _ in range(2))
    lm_scoring.refine(rows, model, Scratch(spark, "refine"), fan=2)
    total, n = 0.0, 0
    for own in parts:
        one, ids = start.copy(), [np.frombuffer(x, "<u4").astype(np.int64) for x in own]
        one.train(ids, epochs=1, rate=lm_scoring.RATE)
        total, n = total + sum(map(len, ids)) * one.flat().astype(float), n + sum(map(len, ids))
    assert len(parts) > 2 and np.abs(model.flat() - start.flat()).max() > 1e-4
    assert np.abs(model.flat() - total / n).max() < 1e-3
    before = model.flat()
    lm_scoring.refine(rows.limit(0), model, Scratch(spark, "refine"))
    assert (model.flat() == before).all()


def test_lm_learns_from_all_training_documents_in_rounds(spark, monkeypatch):
    docs, real, rounds = corpus(spark, extra=[(None, "a b c", None, None, 0)]), lm_scoring.refine, []

    def spy(encoded, model, *rest, **more):
        ids, before = [r.ids for r in encoded.collect()], model.flat()
        real(encoded, model, *rest, **more)
        rounds.append((sum(map(len, ids)) // 4, before, model.flat()))

    monkeypatch.setattr(lm_scoring, "refine", spy)
    got = lm_scoring.score_documents(docs, Scratch(spark, "t"), classes=4, size=8, epochs=1).first()
    assert sum(n for n, _, _ in rounds) == got.train_tokens
    rounds.clear()
    lm_scoring.score_documents(docs, Scratch(spark, "t"), classes=4, size=8, epochs=1, first=1000)
    assert len(rounds) > 2 and sum(n for n, _, _ in rounds) == got.train_tokens
    assert all((a[2] == b[1]).all() and np.abs(b[2] - b[1]).max() > 0 for a, b in zip(rounds, rounds[1:], strict=False))


def test_a_task_goes_on_from_its_last_run(spark):
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 17, 200) for _ in range(4)]
    rows = spark.createDataFrame(pa.table({"ids": pa.array([t.astype("<u4").tobytes() for t in texts], pa.binary())})).coalesce(1)
    one, model = (GatedModel(np.ones(16), 1.0, 4, 4) for _ in range(2))
    lm_scoring.refine(rows, model, Scratch(spark, "refine"), chunk=200)
    for t in texts:
        one.train([t], epochs=1, rate=lm_scoring.RATE)
    assert np.abs(model.flat() - one.flat()).max() < 1e-5


def test_scores_equal_brute_force(spark, monkeypatch):
    made = []
    monkeypatch.setattr(lm_scoring, "GatedModel", lambda *a: made.append(GatedModel(*a)) or made[-1])
    docs = corpus(spark, 60, extra=[(5000, "ABC abc aBc", None, None, 0), (7, "again", None, None, 0), (None, "a b", None, None, 0)])
    rows = [(r.doc_id, [*[w.lower() for w in words(r.text)], b"\0end"]) for r in docs.collect()]
    counts = Counter(t for k, ts in rows if fold(k, 5) != 1 for t in ts)
    got = lm_scoring.score_documents(docs, Scratch(spark, "t"), classes=4, size=8, epochs=1, first=1000).collect()
    model, key = made[0], lambda t: int(lm_scoring.END) if t == b"\0end" else int(lm_scoring.words_of(pa.array([t.decode()])).hashes[0])
    ranked = sorted(counts, key=lambda t: (-counts[t], key(t)))
    rank = {t: i for i, t in enumerate(ranked[:32])}
    p = {k: v.astype(float) for k, v in model.p.items()}
    rest = sum(counts[t] for t in ranked[32:]) + 0.5 * (len(ranked) - 32 + 1)
    soft = lambda x: x - math.log(np.exp(x).sum())

    def score(tokens):
        h, total, before = np.zeros(model.hidden), 0.0, 33
        for t in tokens:
            x, a = p["e"][before] @ p["w"] + p["b"], h @ p["u"]
            z, r = (1 / (1 + np.exp(-(x + a)[i * model.hidden : (i + 1) * model.hidden])) for i in (0, 1))
            g = np.tanh(x[2 * model.hidden :] + r * a[2 * model.hidden :])
            h = (1 - z) * g + z * h
            now = rank.get(t, 32)
            total += soft(h @ p["c"] + p["cb"])[now // 8]
            total += soft(p["v"][now // 8] @ h + p["vb"][now // 8])[now % 8] if now < 32 else math.log((counts[t] + 0.5) / rest)
            before = now
        return total / math.log(10)

    want, seen = sorted((k or -1, len(ts), score(ts)) for k, ts in rows), sorted((r.doc_id or -1, r.n_tokens, r.score) for r in got)
    assert len(want) == len(seen) and len(rank) == 32
    for a, b in zip(want, seen, strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=2e-4, abs_tol=1e-3)


@pytest.mark.parametrize("n", [1, 50, 129, 1000, 4099])
def test_every_token_is_learned_from(monkeypatch, n):
    rng, seen, real = np.random.default_rng(n), [], GatedModel._window
    texts = [rng.integers(0, 17, k) for k in np.diff([0, *sorted(rng.integers(0, n + 1, 5)), n])]
    monkeypatch.setattr(GatedModel, "_window", lambda self, ids, target, *rest: seen.append(target[target >= 0]) or real(self, ids, target, *rest))
    model = GatedModel(np.ones(16), 1.0, 4, 4)
    loss = model.train(texts, epochs=1)
    seen = np.concatenate(seen)
    assert len(seen) == n and (np.bincount(seen, minlength=17) == np.bincount(np.concatenate(texts), minlength=17)).all()
    assert math.isfinite(loss[0])


def test_gru_is_a_distribution_and_its_state_is_carried():
    rng = np.random.default_rng(0)
    model = GatedModel(rng.integers(1, 50, 12).astype(float), 9.0, classes=3, size=4, hidden=5)
    data = [rng.integers(0, 13, 50) for _ in range(20)]
    losses = model.train(data, streams=4, window=8, epochs=6)
    assert losses[-1] < losses[0]
    past = [3, 12, 7]
    total = sum(math.exp(s) for s in model.score([np.array([*past, w]) for w in range(13)]) - model.score([np.array(past)]))
    assert abs(total - 1) < 1e-5  # the other words are one outcome here
    together, alone = model.score(data), [model.score([t], hold=7)[0] for t in data]
    assert np.allclose(together, alone, atol=1e-4) and model.score([np.zeros(0, int)])[0] == 0


def test_gru_gradients_are_those_of_differences():
    rng = np.random.default_rng(1)
    model = GatedModel(np.ones(4), 1.0, classes=2, size=2, hidden=3)
    for k, v in model.p.items():
        model.p[k] = v.astype(np.float64) + rng.normal(0, 0.2, v.shape)
    ids, target, h = rng.integers(0, 6, (5, 2)), rng.integers(0, 5, (5, 2)), rng.normal(size=(2, 3))
    _, grads, _ = model._window(ids, target, h)
    for k, v in model.p.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        v[at] += 1e-5
        up = model._window(ids, target, h)[0]
        v[at] -= 2e-5
        down = model._window(ids, target, h)[0]
        v[at] += 1e-5
        assert math.isclose((up - down) / 2e-5, grads[k][at], rel_tol=1e-3, abs_tol=1e-6), k


@pytest.mark.parametrize("part", [4096, 40])
def test_nearest_recall_ties_and_odd_vectors(spark, part):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    v = rng.normal(size=(900, 16)).astype("float32")
    v[100:180] = v[100]
    rows = [(i, v[i].tolist(), 0) for i in range(900)]
    odd = [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] + [1.0] * 15, 0), (2150, [float("inf")] + [1.0] * 15, 0), (2200, [None] + [1.0] * 15, 0), (2250, [1.0, 2.0], 0), (2251, [2.0, 4.0], 0), (2252, [2.0, 1.0], 0), (None, v[0].tolist(), 0), (2300, [], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("tree", F.lit(1))
    got = neighbours.nearest(table, F.col("vec_id") % 50 == 0, Scratch(spark, "t"), part=part, leaf=64).toPandas()
    assert not set(got.query_id) & {2000, 2050, 2100, 2150, 2200, 2300} and got.groupby("query_id")["rank"].apply(list).map(lambda r: r == list(range(1, len(r) + 1))).all()
    assert got[got.query_id == 2250].sort_values("rank").vec_id.tolist() == [2251, 2252]
    w, hits = v.astype(float), 0
    norm = np.sqrt((w * w).sum(axis=1))
    for q in range(0, 900, 50):
        score = (w * w[q]).sum(axis=1) / (norm * norm[q])
        score[q] = -9
        own = got[got.query_id == q].sort_values("rank")
        assert np.array_equal(own.score.to_numpy(), score[own.vec_id])
        best = np.lexsort((np.arange(900), -score))[:5]
        hits += len(set(best) & set(own.vec_id))
        if 100 <= q < 180:
            assert own.vec_id.tolist() == [i for i in range(100, 106) if i != q][:5]
    assert hits >= 0.9 * 5 * 18
    assert neighbours.nearest(table.limit(0), F.lit(True), Scratch(spark, "t")).count() == 0
    assert pd.api.types.is_integer_dtype(got["rank"])


def test_vectors_of_one_id_are_one_query_and_one_candidate(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(220, 8))
    v[1:6], v[101:106] = v[200], v[201]
    rows = [(i, v[i].tolist()) for i in range(1, 200)] + [(0, v[200].tolist()), (0, v[201].tolist()), (0, v[201].tolist()), (3, v[7].tolist())]
    size, best = lambda x: np.sqrt((x * x).sum()), {}
    for i, x in rows:
        for j, y in rows:
            if i % 50 == 0 and i != j:
                a, b = np.array(y), np.array(x)
                best[i, j] = max(best.get((i, j), -9.0), float((a * b).sum() / (size(a) * size(b))))
    want = {i: sorted((-s, j) for (q, j), s in best.items() if q == i)[:5] for i in (0, 50, 100, 150)}
    for order in (rows, rows[::-1], sorted(rows)):
        got = neighbours.nearest(spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0, Scratch(spark, "t"), leaf=512).collect()
        for q, own in want.items():
            assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == own


def test_recall_on_the_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = neighbours.nearest(rows, F.col("vec_id") % 50 == 0, Scratch(spark, "t")).toPandas()
    table = rows.select("vec_id", "embedding").toPandas()
    v, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    unit, hits, total = v / np.sqrt((v * v).sum(axis=1, keepdims=True)), 0, 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[i]
        score[i] = -9
        want = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        total, hits = total + 5, hits + len(want & set(got.vec_id[got.query_id == ids[i]]))
    assert total and hits >= 0.9 * total
