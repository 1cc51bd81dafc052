"""Substring dedup: words of passages that also start in an earlier document are removed.

Suffix automata of reference shards, past which documents stream for their matching statistics.
The reference is the corpus itself, so no broadcast of all shards would have a size bound, and
every document would pass every shard. Content-defined anchors bring each passage to the one
small shard that can hold it:

1. Every window has the least hash of its runs of `anchor` words as its anchor; equal windows have
   equal anchors. Windows of one document with one anchor are a segment, of at most
   `2 * window - anchor` words or so.
2. Anchors of two documents of different texts are kept (one aggregation, one join). A
   document whose whole text an earlier one has loses all it would lose by windows, and takes no
   part in what follows.
3. Segments of an anchor are its shard. Equal segments are one, that of the least doc_id. Where there are
   several, each in order of doc_id streams past the automaton of those before it; matches of
   `window` words or more are what goes, and then the automaton takes it in.
4. An anchor of more than `most` segments, such as that of a very common line, is no shard: there every window
   is a segment by itself, under a hash of all its words. Equal ones are one by aggregation, and nothing is left for an automaton to tell.
5. Marks of segments are gathered by document (at most as many as it has words) and
   the words they cover are left out.

Words are told apart by 64-bit hashes. Texts are compressed before an exchange. Nothing is broadcast, no group is gathered but the
segments of an anchor, `most` at the utmost, and the marks of one document; a passage in a
third of all documents is a hot key only for aggregations that combine before the exchange and
for joins that Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch
from gridloom.llm.suffix_automaton import SuffixAutomaton
from gridloom.llm.words import gathered, grams, mix, released, slices, words_of

#: Words of a window and of an anchor, and most segments of one automaton's shard.
WINDOW, ANCHOR, MOST = 50, 12, 1024


def _run(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over values[i:i + size] for every i that has a full run."""
    out, have = values, 1
    while have * 2 <= size:
        out, have = pick(out[: len(out) - have], out[have:]), have * 2
    return out if have == size else pick(out[: len(values) - size + 1], out[size - have :])


def segments_of(hashes: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments in the concatenated word hashes: anchor, place of the first window, number of windows, document.

    The lowest byte of an anchor's hash gives way to its place, so that the least hash says where it is.
    """
    span = window - anchor + 1
    if not 0 < span <= 63:
        raise ValueError("a window has 1 to 63 anchors")
    g = grams(hashes, anchor)
    if len(g) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # places count from the beginning of the document, so that its segments don't depend on what lies before it
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(g)]
    place = np.arange(len(g)) - first[doc]
    least = _run((g & ~np.uint64(255)) | (place & 255).astype(np.uint64), span, np.minimum)
    doc, place = doc[: len(least)], place[: len(least)]
    ok = np.flatnonzero(np.arange(len(least)) + window <= first[1:][doc])
    if not len(ok):
        return np.zeros(0, np.uint64), ok, ok, ok
    at = ok + (((least[ok] & np.uint64(255)).astype(np.int64) - place[ok]) & 255)
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (doc[ok][1:] != doc[ok][:-1])))
    return least[ok][new] >> np.uint64(8), ok[new], np.diff(np.append(new, len(ok))), doc[ok][new]


def _cover(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + window, n), -1)
    return np.cumsum(delta[:n]) > 0


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column text as compressed bytes; the others stay."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for part in slices(batch):
            data = pa.array([None if x is None else press.compress(x.encode()) for x in part.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([data if i == at else c for i, c in enumerate(part.columns)], part.schema.names)


def _opened(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else press.decompress(x).decode() for x in column.to_pylist()], pa.string())


def _pressed_slices(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose compressed texts open to about size bytes, one row at least: some texts shrink to a hundredth."""
    texts = batch.column(batch.schema.get_field_index("text"))
    ends = np.cumsum([0] + [zstandard.frame_content_size(x.as_py()) if x.is_valid else 0 for x in texts])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def pressed(rows: DataFrame) -> DataFrame:
    """rows with text as zstandard frames, about two fifths of its size."""
    schema = ", ".join(f"`{c}` {'binary' if c == 'text' else t}" for c, t in rows.dtypes)
    return rows.mapInArrow(released(_pressed), schema)


def _anchor_rows(window: int, anchor: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                w = words_of(part.column(1))
                h, _, _, doc = segments_of(w.hashes, w.first, window, anchor)
                nth = np.arange(len(h)) - np.searchsorted(doc, doc)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0).take(take), part.column(2).take(take), pa.array(nth.astype(np.int32))], ["anchor", "doc_id", "key", "nth"])

    return rows


def _segment_rows(window: int, anchor: int):
    """Segments of rows (doc_id, key, text, asked): those of `asked`, twice their number and 1 if the anchor is a hot one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pressed_slices(batch):
                w = words_of(_opened(part.column(2)))
                h, at, n, doc = segments_of(w.hashes, w.first, window, anchor)
                from_ = np.searchsorted(doc, np.arange(part.num_rows))
                size = part.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                asked = part.column(3).flatten().to_numpy(zero_copy_only=False)
                nth = np.sort((np.repeat(from_, size) + (asked >> 1)) * 2 + (asked & 1))
                hot, nth = nth & 1 == 1, nth >> 1
                # hot ones are cut into single windows, under the hash of the window
                one = gathered(at[nth[hot]], n[nth[hot]])
                every = grams(w.hashes, window)[one] if len(one) else np.zeros(0, np.uint64)
                own = nth[~hot]
                lens = n[own] + window - 1
                body = w.hashes[gathered(at[own], lens)]
                with np.errstate(over="ignore"):
                    place = np.arange(len(body)) - np.repeat(np.cumsum(lens) - lens, lens)
                    digest = mix(np.add.reduceat(mix(body + place.astype(np.uint64)), np.cumsum(lens) - lens) + lens.astype(np.uint64)) if len(own) else np.zeros(0, np.uint64)
                raw, ends = body.tobytes(), (8 * np.cumsum(lens)).tolist()
                body = pa.array([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)] + [None] * len(one), pa.binary())
                doc = np.concatenate([doc[own], np.repeat(doc[nth[hot]], n[nth[hot]])])
                start = np.concatenate([at[own], one]) - w.first[doc]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[own], every]).view(np.int64)), pa.array(np.concatenate([digest, every]).view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(np.concatenate([n[own], np.ones(len(one), np.int64)]).astype(np.int32)), body], ["anchor", "digest", "doc_id", "key", "start", "n", "body"])

    return rows


def _streamed(window: int):
    """(anchor, digest, mask) of rows (anchor, lo, digest, body) in this order: a bit for each window that a segment of a smaller lo has."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, group, held = SuffixAutomaton(), None, []  # held: segments of one lo, which don't see each other
        for batch in batches:
            out = []
            for anchor, lo, digest, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (anchor, lo) != group:
                    if group is None or anchor != group[0]:
                        automaton, held = SuffixAutomaton(), []
                    for other in held:
                        automaton.add(other)
                    group, held = (anchor, lo), []
                words, mask = np.frombuffer(body, np.uint64).tolist(), 0
                for i, long in enumerate(automaton.matches(words), 1 - window):
                    if long >= window:
                        mask |= 1 << i
                held.append(words)
                if mask:
                    out.append((anchor, digest, mask))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["anchor", "digest", "mask"])

    return rows


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """(doc_id, key, marks array<struct<start, mask>>, whole): windows that also start in a document with a smaller doc_id.

    key is xxhash64 of the text. Bit i of a mask is the window that begins at word start + i.
    Where `whole` is true such a document has the same text, and marks are null: every window goes.
    """
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).where("doc_id is not null and length(text) >= %d" % (2 * window - 1))
    digests = text.select("doc_id", "key", F.md5(F.col("text").cast("binary")).alias("md5"))
    first = digests.groupBy("md5").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("md5", "lo")
    copies = digests.join(first, "md5").where("doc_id > lo").select("doc_id", "key").distinct()
    anchors = text.select("doc_id", "text", "key").mapInArrow(released(_anchor_rows(window, anchor)), "anchor long, doc_id long, key long, nth int")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n")).where("lo < hi and a < b").select("anchor", (F.col("n") > most).cast("int").alias("hot"))
    by_doc = anchors.join(shared, "anchor").groupBy("doc_id", "key").agg(F.collect_set(F.col("nth") * 2 + F.col("hot")).alias("asked")).join(copies, ["doc_id", "key"], "left_anti")
    made = pressed(text.select("doc_id", "key", "text")).join(by_doc, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "text", "asked")
    segments = scratch.keep(made.mapInArrow(released(_segment_rows(window, anchor)), "anchor long, digest long, doc_id long, key long, start int, n int, body binary"), "segments")
    contents = scratch.keep(segments.groupBy("anchor", "digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("n").alias("n")), "contents")
    several = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("kinds > 1 and lo < hi").select("anchor")
    told = contents.join(several, "anchor").select("anchor", "digest", F.col("lo").alias("doc_id"))
    bodies = segments.select("anchor", "digest", "doc_id", "body").join(told, ["anchor", "digest", "doc_id"]).dropDuplicates(["anchor", "digest"])
    masks = bodies.select("anchor", F.col("doc_id").alias("lo"), "digest", "body").repartition("anchor").sortWithinPartitions("anchor", "lo", "digest").mapInArrow(released(_streamed(window)), "anchor long, digest long, mask long")
    gone = contents.join(masks, ["anchor", "digest"], "left").where("lo < hi or mask is not null").select("anchor", "digest", "lo", F.coalesce("mask", F.lit(0)).alias("mask"))
    mask = F.when(F.col("doc_id") > F.col("lo"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("mask"))
    marks = segments.select("anchor", "digest", "doc_id", "key", "start", "n").join(gone, ["anchor", "digest"]).select("doc_id", "key", "start", mask.alias("mask")).where("mask <> 0")
    marks = marks.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    return marks.select("doc_id", "key", "marks", F.lit(False).alias("whole")).union(copies.select("doc_id", "key", F.lit(None).cast("array<struct<start:int,mask:bigint>>"), F.lit(True)))


def _starts(marks: pa.Scalar) -> np.ndarray:
    """Words at which windows begin that go."""
    if not marks.is_valid:
        return np.zeros(0, np.int64)
    start, mask = (marks.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    row, bit = np.nonzero((mask[:, None] >> np.arange(63)) & 1)
    return start[row] + bit


def _kept(window: int, digest: bool, out: list[str]):
    """Adds n_words, n_removed and either the digest of the kept words or the new text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pressed_slices(batch):
                text, marks, whole = _opened(part.column(part.schema.get_field_index("text"))), part.column(part.schema.get_field_index("__marks")), part.column(part.schema.get_field_index("__whole"))
                words, removed, made = [], [], []
                for raw, at, all_ in zip(text, marks, whole.to_pylist(), strict=True):
                    own = raw.as_py()
                    word = (own or "").encode().split()
                    n, kept = len(word), word
                    at = np.arange(max(0, n - window + 1)) if all_ else _starts(at)
                    if len(at):
                        gone = _cover(at, n, window)
                        kept = [x for x, g in zip(word, gone.tolist(), strict=True) if not g]
                    words.append(n)
                    removed.append(n - len(kept))
                    joined = b" ".join(kept) if digest or len(at) else None
                    made.append(hashlib.sha256(joined).hexdigest() if digest else own if joined is None else joined.decode())
                new = {"n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256" if digest else "text": pa.array(made, pa.string())}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(part.schema.get_field_index(c)) for c in out], out)

    return rows


def _marked(rows: DataFrame, docs: DataFrame, scratch: Scratch, window: int, anchor: int, most: int) -> DataFrame:
    """rows with text compressed, __marks and __whole."""
    marks = repeated_windows(docs, scratch, window, anchor, most).select("doc_id", F.col("key").alias("__key"), F.col("marks").alias("__marks"), F.col("whole").alias("__whole"))
    keyed = rows.withColumn("__key", F.xxhash64("text"))
    return pressed(keyed).join(marks, ["doc_id", "__key"], "left").select(*rows.columns, "__marks", "__whole")


def remove_repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """docs with `text` without repeated passages, and n_words, n_removed.

    Words are runs of characters outside 0x20 and 0x09-0x0D. A text that loses words becomes its
    kept words joined by one space; any other stays as it is, a null too (0 words). The first
    document (least doc_id) keeps a passage; a passage repeated in one document only stays. Rows
    that share a doc_id are one document, none of which is earlier than another, and each is judged on
    its own words; rows without doc_id stay whole. Other columns pass through; an empty table gives none. The columns n_words and
    n_removed of the input are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    rows = _marked(docs.select(*own), docs, scratch, window, anchor, most)
    schema = docs.select(*own).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return rows.mapInArrow(released(_kept(window, False, schema.names)), schema)


def digests(docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of what remove_repeats() keeps."""
    rows = _marked(docs.select("doc_id", "text"), docs, scratch, window, anchor, most)
    return rows.mapInArrow(released(_kept(window, True, ["doc_id", "n_words", "n_removed", "kept_sha256"])), "doc_id long, n_words long, n_removed long, kept_sha256 string")

