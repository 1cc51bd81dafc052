"""The pipeline, stage by stage, against brute force; and the queries over whole tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import mixing, queries
from tests.llm.helpers import SCHEMA, corpus, words
from tests.llm.test_dedup import grouped, removed
from tests.llm.test_native import like, sketch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    corpus(spark, extra=[(4000, "no words 12", "en", "src5", None), (4001, "77 !!", "en", "src5", None)]).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return str(folder), out


def test_each_stage_equals_brute_force(stages):
    _, (start, language, near, passages, mixed, packed) = stages
    assert {r.doc_id for r in language} == {r.doc_id for r in start if r.text and any(c.isalpha() for c in r.text)}
    text = {r.doc_id: r for r in start}
    assert all(r == text[r.doc_id] for r in language + near)
    want = grouped(language)
    assert sorted(r.doc_id for r in near) == sorted(k for k, (_, c) in want.items() if k == c)
    cut = removed(near)
    assert {r.doc_id: r.text for r in passages} == {r.doc_id: cut[r.doc_id][3] if cut[r.doc_id][1] else r.text for r in near if not cut[r.doc_id][1] or cut[r.doc_id][1] < cut[r.doc_id][0]}
    assert sum(c[1] for c in cut.values()) > 50
    assert sorted(map(repr, mixed)) == sorted(map(repr, passages))
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    for r in packed:
        assert sum(p.length for p in packed if p.doc_id == r.doc_id) == r.doc_tokens


def test_mixed_rows_are_written_in_order(spark, stages):
    folder, out = stages
    rows = {r.doc_id: (r.mix_slot, r.mix_start) for r in mixing.schedule(spark.read.parquet(f"{folder}/substring_dedup"), queries.WEIGHTS).collect()}
    files = {}
    for r in spark.read.parquet(f"{folder}/mixing").select("doc_id", F.input_file_name().alias("file")).collect():
        files.setdefault(r.file, []).append(rows[r.doc_id])
    order = [x for _, own in sorted(files.items()) for x in own]  # a file a range, numbered in order
    assert order == sorted(order) and len(order) == len(rows) == len(out[4]) and len(files) > 2


def test_sequences_lie_in_ranges_of_the_mix(spark, stages):
    folder, out = stages
    place = {r.doc_id: (r.mix_slot, r.mix_start) for r in mixing.schedule(spark.read.parquet(f"{folder}/mixing"), queries.WEIGHTS).collect()}
    for rows in (out[5], corpus_pipeline.run(spark, folder).collect()):
        shards = {}
        for r in rows:
            shards.setdefault(r.sequence_id >> 32, []).append(place[r.doc_id])
        ranges = [(min(own), max(own)) for _, own in sorted(shards.items())]
        assert len(ranges) > 2 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_run_returns_the_last_stage(spark, stages):
    folder, out = stages
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in out[5])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    assert rows.count() > 0 and not any(kind == "void" for _, kind in rows.dtypes)


def test_queries_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op8_near_dedup"](spark, SF).collect()}
    assert got == grouped(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op6_substring_dedup"](spark, SF).collect()}
    assert got == {k: v[:3] for k, v in removed(docs).items()}
    order = sorted(docs, key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in queries.QUERIES["op5_fingerprints"](spark, SF).collect()}
    for a, b in zip(order[:60], order[1:], strict=False):
        assert math.isclose(got[a.doc_id].near_next, like(sketch(a.text), sketch(b.text)))
        assert got[a.doc_id].n_chars == len(a.text) and (got[a.doc_id].fingerprint == "") == (not words(a.text))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "start", "length"]


def test_pipeline_of_repeated_rows(spark, tmp_path):
    """Every text that is kept is kept once, whatever ids repeat, and no text of an id is lost for another's sake."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one, "en", "src0", 9), (1, one, "en", "src0", 9), (2, one, "de", "src1", 9), (2, two, "de", "src1", 9), (2, three, "de", None, None), (None, "null id", "en", "src0", 1), (None, "null id", "en", "src0", 1), (7, None, None, None, None), (7, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = Counter([1, 2, 2, None, None])
    assert Counter(r.doc_id for r in got) == want and all(r.start == 0 and r.length == r.doc_tokens for r in got)
    assert len({r.ids_crc32 for r in got if r.doc_id is not None}) == 3
