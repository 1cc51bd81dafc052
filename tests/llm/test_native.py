import datetime
import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import fingerprint, mixing, url_filter
from tests.llm.helpers import SCHEMA, clashing, corpus, words


def sketch(text):
    w = words(text)
    runs = [w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else []
    hashes = set()
    for run in runs:
        h = 42
        for x in run:
            h = xxhash.xxh64(x, seed=h).intdigest()
        hashes.add(h - (1 << 64) if h >= 1 << 63 else h)
    limit = -(1 << 63) + int((1 << 64) / 16)
    return sorted({h for h in hashes if h < limit} | ({min(hashes)} if hashes else set()))


def like(a, b):
    return len(set(a) & set(b)) / max(1, len(set(a) | set(b))) if a or b else 1.0


def python_words(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.mark.parametrize("per_bucket", [128, 4])
def test_fingerprints_equal_brute_force(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", (per_bucket, 1 << 14))
    docs = corpus(spark)
    rows = sorted(python_words(docs), reverse=True)
    want = {}
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = sketch(text), sketch(edited), sketch(following)
        hexed = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in s)
        want[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), like(a, b), like(a, c))
    got = {r.doc_id: tuple(r)[1:] for r in fingerprint.compare_with_edits(clashing(docs)).collect()}
    assert got == want


def test_fingerprints_of_odd_tables(spark):
    assert fingerprint.compare_with_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fingerprint.compare_with_edits(spark.createDataFrame([(1, "a b c d e f", "", "", 0)], SCHEMA)).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(("a b c d e f"[:8] + "a b").encode()).hexdigest()
    rows = [(None, "a b c", "", "", 0), (None, None, "", "", 0), (2, "x", "", "", 0), (2, "x", "", "", 0)]
    got = fingerprint.compare_with_edits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.doc_id == 2}) == 1


def test_sketches_of_parts_merge_to_that_of_the_whole(spark):
    rng, rows = random.Random(0), []
    for k in range(120):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 4, 5, 9, 30, 400]))]
        cut = rng.randint(0, len(w))  # parts overlap by four words, so their shingles are those of the whole
        a, b = (w[: cut + 4], w[cut:]) if 1 <= cut <= len(w) - 5 else (w, w)
        rows.append((k, " ".join(w), " ".join(a), " ".join(b)))
    table = spark.createDataFrame(rows, "k int, whole string, a string, b string").select("k", "a", *[fingerprint.sketch(F.col(c)).alias(f"s{c[0]}") for c in ("whole", "a", "b")], F.col("b"))
    table = table.select("k", F.col("sw").alias("whole"), "sa", "sb", fingerprint.merge(F.col("sa"), F.col("sb")).alias("both"))
    parts = table.select("k", F.explode(F.array("sa", "sb", F.array().cast("array<bigint>"))).alias("sketch"))
    union = {r.k: r.sketch for r in fingerprint.merged(parts.union(parts.limit(0)), ["k"]).collect()}
    for r in table.collect():
        assert r.both == r.whole == union[r.k], r.k
    assert any(len(r.whole) == 1 for r in table.collect()) and [] in union.values()
    empty = spark.createDataFrame([(1, None), (1, []), (None, None)], "k int, sketch array<bigint>")
    assert sorted((r.k or 0, r.sketch) for r in fingerprint.merged(empty, ["k"]).collect()) == [(0, []), (1, [])]


def test_containment_of_unequal_texts(spark):
    w = [f"w{i}" for i in range(4000)]
    row = spark.createDataFrame([(" ".join(w), " ".join(w[:800]))], "a string, b string").select(fingerprint.containment(fingerprint.sketch(F.col("b")), fingerprint.sketch(F.col("a"))).alias("x"), fingerprint.containment(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))).alias("y")).first()
    assert row.x == 1.0 and abs(row.y - 0.2) < 0.08


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 7}, {"src0": 10, **{f"s{i}": 3 + i % 5 for i in range(30)}}])
def test_schedule_is_never_a_block_away(weights):
    slots, total = mixing.period(weights), sum(weights.values())
    assert sorted(t for s in slots.values() for t in s) == list(range(total))
    for s, n in weights.items():
        for k, t in enumerate(slots[s]):
            assert k * total // n <= t < -(-(k + 1) * total // n)
        done = 0
        for t in range(total):
            done += t in slots[s]
            assert abs(done * total - (t + 1) * n) < total


def test_mixing_places_every_row(spark):
    docs = corpus(spark, extra=[(None, "abc", None, "src1", 0), (None, None, None, None, None), (3, "again", None, "src0", 0)])
    weights = {"src0": 3, "src1": 2}
    got = mixing.schedule(clashing(docs), weights, block=500).toPandas()
    assert len(got) == docs.count() and set(got.mix_source) == {"src0", "src1", "*"}
    full = weights | {"*": 1}
    slots = mixing.period(full)
    for s, own in got.groupby("mix_source"):
        own = own.assign(size=[max(1, len(t or "")) for t in own.text], key=[hashlib.md5((str(int(i)) if i == i else "").encode()).hexdigest() for i in own.doc_id])
        own = own.sort_values("mix_start")
        assert own.mix_start.tolist() == [0, *own["size"].cumsum().tolist()[:-1]] and own.key.is_monotonic_increasing
        for b, r, d, t in zip(own.mix_block, own.mix_release, own.mix_deadline, own.mix_slot, strict=True):
            n = full[s]
            assert (r, d, t) == (b * 6 // n, -(-(b + 1) * 6 // n), b // n * 6 + slots[s][b % n]) and r <= t < d
    mixed = mixing.mixed(docs, weights, block=500)
    assert mixed.columns == docs.columns and mixed.count() == docs.count()
    assert mixing.schedule(spark.createDataFrame([], SCHEMA), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.period({"a": 0})


def test_url_filter_decides_as_of_the_fetch(spark):
    day = lambda n: datetime.date(2024, 1, n)
    entries = spark.createDataFrame([("b.com", "block", "add", day(5)), ("b.com", "block", "remove", day(10)), ("b.com", "block", "add", day(20)), ("b.com/ok", "allow", "add", day(1)), ("x.b.com", "allow", "add", day(7)), ("same.org", "block", "add", day(1)), ("same.org", "allow", "add", day(1)), ("off.org", "block", "add", day(3)), ("off.org", "block", "remove", day(3)), (None, "block", "add", day(1))], "pattern string, kind string, action string, dated date")
    urls = ["http://b.com/", "https://B.com/ok/y?q=1", "http://x.b.com/a", "http://y.x.b.com", "http://notb.com/", "http://same.org#z", "http://off.org:80/", "nonsense", "", None]
    rows = [(i, u, day(d), "e") for d in (4, 5, 9, 10, 25) for i, u in enumerate(urls)] + [(0, urls[0], None, "e"), (None, urls[0], day(6), "e"), (0, urls[0], day(9), "e")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, pattern string")

    def decide(url, at):
        if at is None or not url or "://" not in url:
            return "none"
        rest = url.split("://")[1].lower()
        host = rest.split("/")[0].split("#")[0].split(":")[0]
        blocked = at in (day(5), day(6), day(9), day(25))
        if host == "b.com" and "/ok" in rest:
            return "allow"
        if host.endswith("x.b.com") and at >= day(7):
            return "allow"
        if host == "same.org":
            return "allow"
        return "block" if blocked and (host == "b.com" or host.endswith(".b.com")) else "none"

    long = ["http://b.com/" + "s/" * 20_000, "http://b.com/ok/" + "s/" * 20_000, "http://" + "a." * 5_000 + "b.com/", "http://" + "a." * 5_000 + "x.b.com/ok/y"]
    deep = spark.createDataFrame([(900 + i, u, day(9), "e") for i, u in enumerate(long)], captures.schema)
    assert [r.decision for r in url_filter.filter_urls(deep, entries).orderBy("page_id").collect()] == ["block", "allow", "block", "allow"]
    assert url_filter.reach(entries) == (3, 1)
    got = url_filter.filter_urls(captures, entries).collect()
    assert len(got) == len(set(r[:3] for r in rows))
    for r in got:
        assert r.decision == decide(r.url, r.fetched), r
    assert {r.decision for r in url_filter.filter_urls(captures, entries.limit(0)).collect()} == {"none"}
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0
