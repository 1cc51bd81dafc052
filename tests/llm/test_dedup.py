import hashlib
import random

import pyarrow as pa
import pytest

from gridloom.llm import near_dedup, substring_dedup
from gridloom.llm.graph import components
from gridloom.llm.near_dedup import UnionFind
from gridloom.llm.scratch import Scratch
from gridloom.llm.words import words_of
from tests.llm.helpers import SCHEMA, clashing, corpus, words


def removed(rows, window=50):
    seen, out = {}, {}
    for doc_id, text in sorted((r.doc_id, r.text) for r in rows):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), doc_id) < doc_id:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode())
    return out


@pytest.mark.parametrize(("change", "most"), [(lambda d: d, 1024), (clashing, 1024), (clashing, 2), (clashing, 6)])
def test_repeated_passages_go_exactly(spark, change, most):
    docs = corpus(spark)
    want = removed(docs.na.fill({"text": ""}).collect())
    got = {r.doc_id: r for r in substring_dedup.digests(change(docs), Scratch(spark, "t"), most=most).collect()}
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == {k: v[:3] for k, v in want.items()}
    assert sum(r.n_removed for r in got.values()) > 200
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in substring_dedup.remove_repeats(change(docs), Scratch(spark, "t")).collect():
        assert r.text == (want[r.doc_id][3] if r.n_removed else text[r.doc_id])


def test_substring_dedup_of_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(None, long, None, None, None), (None, long, None, None, None), (5, long, None, None, None), (5, long, None, None, None), (7, long, None, None, None), (8, " ".join(["a"] * 200), None, None, None), (9, " ".join(["a"] * 60), None, None, None)]
    got = substring_dedup.digests(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (0, 0), (5, 0), (5, 0), (7, 300), (8, 0), (9, 60)]
    assert substring_dedup.digests(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_rows_of_one_doc_id_lose_their_own_words(spark, parts):
    """(doc_id, text, words that go) where texts share passages across and within ids."""
    rng = random.Random(2)
    own = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(120)
    rows = [(1, passage, 0), (2, own(300) + passage, 120), (2, own(70), 0), (2, passage, 120), (2, passage[:70] + own(5), 70), (3, own(20) + passage[30:110] + own(30), 80), (3, passage[:49] + own(60), 0), (2, own(300), 0)]
    rows += [(4, rows[1][1], 420), (5, rows[2][1], 70), (6, rows[2][1] + ["end"], 70)]
    docs = spark.createDataFrame([(k, " ".join(w), None, None, None) for k, w, _ in rows], SCHEMA).repartition(parts)
    want = sorted((k, len(w), n) for k, w, n in rows)
    for most in (1024, 2):
        got = substring_dedup.digests(docs, Scratch(spark, "t"), most=most).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == want
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, Scratch(spark, "t")).collect()) == want


def test_segments_of_a_document_depend_on_it_alone():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 400))) for _ in range(60)] + [" ".join(["x y"] * 300), "z " * 700, " ".join(f"u{i % 30}" for i in range(900))]
    alone = []
    for k, text in enumerate(texts):
        w = words_of(pa.array([text]))
        h, at, n, _ = substring_dedup.segments_of(w.hashes, w.first, 50, 12)
        alone += [(k, *map(int, r)) for r in zip(h, at, n, strict=True)]
        assert n.sum() == max(0, len(w.hashes) - 49) and (n <= 39).all()
    w = words_of(pa.array(texts))
    h, at, n, doc = substring_dedup.segments_of(w.hashes, w.first, 50, 12)
    assert [(int(d), int(a), int(b) - int(w.first[d]), int(c)) for d, a, b, c in zip(doc, h, at, n, strict=True)] == alone


def grouped(rows):
    sets = {}
    for r in rows:
        w = [x.lower() for x in words(r.text)]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids, uf = sorted(sets), UnionFind(len(sets))
    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[ids[i]], sets[ids[j]]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                uf.join(i, j)
    return {k: (len(sets[k]), ids[uf.find(i)]) for i, k in enumerate(ids)}


@pytest.mark.parametrize(("block", "room", "bucket"), [(4096, 1 << 25, 1024), (3, 1 << 25, 1024), (4096, 4000, 2)])
def test_near_duplicates_equal_brute_force(spark, block, room, bucket):
    docs = corpus(spark, 150)
    want = grouped(docs.collect())
    got = near_dedup.near_duplicates(clashing(docs), Scratch(spark, "t"), block=block, room=room, bucket=bucket).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_near_duplicates_of_odd_tables(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
    rows = [(None, "a b c d e f", "", "", 0), (4, "a b c d e f", "", "", 0), (4, "a b c d e f", "", "", 0), (2, "A B C D E F", "", "", 0), (3, None, "", "", 0), (1, "", "", "", 0)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 0, 1, True), (2, 2, 2, True), (3, 0, 3, True), (4, 2, 2, False), (4, 2, 2, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3]


def test_a_large_cluster_of_loose_links_is_verified_whole(spark):
    """A chain in which only neighbours are linked, beside a crowd that is linked throughout."""
    rng = random.Random(5)
    w = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w[2 * i : 2 * i + 40]), None, None, None) for i in range(60)]
    base = [f"v{i}" for i in range(120)]
    rows += [(100 + i, " ".join(x if k != rng.randrange(120) else f"u{i}" for k, x in enumerate(base)), None, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = grouped(docs.collect())
    assert len({c for _, c in want.values()}) < 20
    for bucket in (1024, 3):
        got = near_dedup.near_duplicates(docs, Scratch(spark, "t"), block=4, bucket=bucket).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_texts_of_one_doc_id_are_judged_each(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one, "x", None, 0), (4, one + " tail", "x", None, 0), (4, two, "x", None, 0), (4, three, "x", None, 0), (4, three, "y", None, 0), (9, two, "x", None, 0), (4, None, "x", None, 0), (5, None, "x", None, 0), (5, " ", "x", None, 0)]
    for parts in (1, 2, 3):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = near_dedup.near_duplicates(docs, Scratch(spark, "t")).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 26, 1, True), (4, 0, 4, True), (4, 26, 4, True), (4, 26, 4, True), (4, 26, 4, True), (4, 27, 1, False), (5, 0, 5, True), (5, 0, 5, True), (9, 26, 4, False)]
        kept = near_dedup.keep_one(docs, Scratch(spark, "t")).collect()
        assert sorted((r.doc_id, r.text, r.lang) for r in kept) == [(1, one, "x"), (4, two, "x"), (4, three, "y"), (5, " ", "x")]


def test_one_row_of_a_repeated_representative_stays(spark):
    rows = [(2, "a b c d e f", "", "", 0), (2, "a b c d e f", "", "", 0), (4, "A B C D E F", "", "", 0), (5, "x y", "de", "", 0), (5, "x y", "en", "", 0), (6, None, "", "", 0), (6, "z", "", "", 0), (None, "n", "", "", 0), (None, "n", "", "", 0)]
    for order in (rows, rows[::-1]):
        kept = near_dedup.keep_one(spark.createDataFrame(order, SCHEMA), Scratch(spark, "t"))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r.doc_id or 0, r.text, r.lang) for r in kept.collect()) == [(0, "n", ""), (0, "n", ""), (2, "a b c d e f", ""), (5, "x y", "en"), (6, "z", "")]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_compressed_texts_are_cut_by_the_size_they_open_to():
    texts = ["same line " * 20_000, None, ""] * 20
    batch = next(substring_dedup._pressed(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    parts = list(substring_dedup._pressed_slices(batch))
    opened = [substring_dedup._opened(p.column(0)).to_pylist() for p in parts]
    assert sum(opened, []) == texts and max(sum(len(t or "") for t in x) for x in opened) <= 1 << 20
