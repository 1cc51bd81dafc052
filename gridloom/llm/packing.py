"""Packing: best-fit decreasing into windows of fixed length.

Tokenising and packing are one pass over the partitions of the table: nothing is shuffled and a
partition holds a few numbers for each document, never its tokens. Documents beyond a window are
first cut into full windows; the rest, longest first, go each to the open window with the least
room that is enough, found in a segment tree indexed by remaining capacity. A shard of at most
`shard` documents of a partition is packed by itself, so memory and time have a bound that does
not grow with the table, at the price of the last windows of each shard.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridloom.llm.words import gathered, hash_runs, released, slices, words_of

WINDOW, END, SHARD, CACHE = 4096, 2, 1 << 17, 1 << 20
#: Bytes of text that are tokenised at a time, and most ids of a part of a word that the cache keeps.
SLICE, LONG = 1 << 20, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'<>|")


class CapacityTree:
    """Open windows by remaining capacity: the least capacity of at least n that some window has."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = bytearray(2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, window: int) -> None:
        if not self.at[room]:
            k = room + self.leaves
            while k and not self.open[k]:
                self.open[k] = 1
                k >>= 1
        self.at[room].append(window)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window, which is taken out; None if there is none."""
        k, is_open = least + self.leaves, self.open
        if not is_open[k]:
            while k > 1 and (k & 1 or not is_open[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if is_open[2 * k] else 2 * k + 1
        room = k - self.leaves
        window = self.at[room].pop()
        if not self.at[room]:
            while k and not (k < self.leaves and (is_open[2 * k] or is_open[2 * k + 1])):
                is_open[k] = 0
                k >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (of length 1 to window), and the number of windows. Ties keep their order."""
    tree, count = CapacityTree(window), 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found, count = (window, count), count + 1
        room, where[i] = found
        offset[i] = window - room
        if room > n:
            tree.add(room - n, int(where[i]))
    return where, offset, count


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level tokenizers write each byte: itself where it prints, else one from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class IdCache:
    """Token ids by 64-bit key: sorted keys, and where the ids of each lie in one array. About 30 bytes a word."""

    def __init__(self):
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """Takes in ascending keys that it lacks."""
        if self.used + len(flat) > len(self.flat):
            more = np.zeros(max(2 * len(self.flat), self.used + len(flat)), "<u4")
            more[: self.used] = self.flat[: self.used]
            self.flat = more
        self.flat[self.used : self.used + len(flat)] = flat
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.used += len(flat)


#: Bytes by what they are to a word's split: a letter of ASCII, the lead byte of a Latin letter, a mark that may trail.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[ord(c) for c in _TAIL]] = True
#: Second bytes of Latin letters below U+0100, by their lead byte.
_SECOND = {0xC2: np.isin(np.arange(256), [0xAA, 0xB5, 0xBA]), 0xC3: (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0) & ~np.isin(np.arange(256), [0x97, 0xB7])}


class WordTokens:
    """Token ids of texts; the tokenizer sees each new part of a word once.

    White space always ends a token and is dropped, so ids of a text are those of its words one
    after another. A word of Latin letters and trailing marks has two parts, as the
    tokenizer's own splitting does, and its letters, lower-cased, go to the tokenizer's model
    directly; any other word is one part. Of a run of texts only distinct words are looked up.
    Words and parts are told apart by 64-bit hashes. A cache that is full, of `most` parts of up
    to `LONG` ids, takes no more; what it lacks is made again.
    """

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        self.full, self.most = Tokenizer.from_file(path), most
        self.model = Tokenizer(self.full.model)
        self.letters = _byte_letters()
        self.parts = IdCache()

    def _made(self, parts: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        size = np.fromiter(map(len, made), np.int64, len(made))
        return size, np.fromiter(chain.from_iterable(made), "<u4", int(size.sum()))

    def _split(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased bytes of words that lie end to end, and how many of them are the letters; 0 where the word is one part."""
        first = np.cumsum(size) - size
        after, before = np.append(data[1:], 0), np.append(0, data[:-1])
        letter = _LETTER[data]
        for lead, second in _SECOND.items():
            letter |= ((data == lead) & second[after]) | ((before == lead) & second[data])
        place = np.arange(len(data)) - np.repeat(first, size)
        core = np.maximum.reduceat(np.where(_MARK[data], 0, place + 1), first)
        whole = np.add.reduceat((letter & (place < np.repeat(core, size))).astype(np.int64), first) == core
        core = np.where(whole, core, 0)
        high = (data >= 65) & (data <= 90) | (before == 0xC3) & (data >= 0x80) & (data <= 0x9E)
        low = np.where(high & (place < np.repeat(core, size)), data + 32, data).astype(np.uint8)
        return low, core

    def _ids(self, data: np.ndarray, size: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids and ids of parts that lie end to end; letters says which are for the model alone."""
        keys = hash_runs(data, size)
        keys, at, nth = np.unique(keys, return_index=True, return_inverse=True)
        place, there = self.parts.find(keys)
        lens = np.where(there, self.parts.size[place] if len(self.parts.keys) else 0, 0).astype(np.int64)
        made, lack = np.zeros(0, "<u4"), np.flatnonzero(~there)
        if len(lack):
            raw, ends = data.tobytes(), np.cumsum(size)
            kind = letters[at[lack]]
            for own, tokenizer in ((lack[kind], self.model), (lack[~kind], self.full)):
                texts = [raw[b - n : b].decode() for b, n in zip(ends[at[own]].tolist(), size[at[own]].tolist(), strict=True)]
                if tokenizer is self.model:
                    texts = [t if t.isascii() else t.encode().decode("latin-1").translate(self.letters) for t in texts]
                n, ids = self._made(texts, tokenizer)
                lens[own] = n
                made = np.append(made, ids)
            order = np.concatenate([lack[kind], lack[~kind]])
            start = np.zeros(len(keys), np.int64)
            start[order] = np.cumsum(lens[order]) - lens[order]
        flat = np.zeros(int(lens.sum()), "<u4")
        begin = np.cumsum(lens) - lens
        held = np.flatnonzero(there)
        flat[gathered(begin[held], lens[held])] = self.parts.flat[gathered(self.parts.at[place[held]], lens[held])]
        if len(lack):
            flat[gathered(begin[lack], lens[lack])] = made[gathered(start[lack], lens[lack])]
            new = lack[lens[lack] <= LONG][: max(0, self.most - len(self.parts.keys))]
            self.parts.add(keys[new], lens[new].astype(np.int32), flat[gathered(begin[new], lens[new])])
        return lens[nth], flat[gathered(begin[nth], lens[nth])]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins."""
        w = words_of(column)
        if not len(w.hashes):
            return np.zeros(0, "<u4"), np.zeros(len(column) + 1, np.int64)
        _, at, nth = np.unique(w.hashes, return_index=True, return_inverse=True)
        size = (w.ends - w.starts)[at]
        low, core = self._split(w.data[gathered(w.starts[at], size)], size)
        both = np.stack([core, size - core], axis=1).reshape(-1)  # letters and the rest of each word
        full = both > 0
        lens = np.zeros(len(both), np.int64)
        lens[full], ids = self._ids(low, both[full], np.tile([True, False], len(size))[full])
        lens = lens.reshape(-1, 2).sum(axis=1)
        begin = np.cumsum(lens) - lens
        return ids[gathered(begin[nth], lens[nth])], np.append(0, np.cumsum(lens[nth]))[w.first]


_TOKENS: dict[str, WordTokens] = {}


def _tokens(file: str) -> WordTokens:
    """The tokenizer of a worker, which outlives its tasks."""
    if file not in _TOKENS:
        _TOKENS[file] = WordTokens(file)
    return _TOKENS[file]


class Pieces:
    """Pieces of documents as five columns of numbers; doc_id by itself, as it may be null."""

    def __init__(self):
        self.docs: list[pa.Array] = []
        self.numbers = [array("q") for _ in range(4)]
        self.held = 0

    def add(self, docs: pa.Array, every: np.ndarray, first: np.ndarray, window: int, end: int) -> None:
        """Cuts the ids every[first[i]:first[i + 1]] of each document, and the end, into windows."""
        last, (starts, lengths, crcs, totals) = end.to_bytes(4, "little"), self.numbers
        edge, data = (4 * first).tolist(), memoryview(every.view(np.uint8))
        total = np.diff(first) + 1
        for a, b, n in zip(edge[:-1], edge[1:], total.tolist(), strict=True):
            if n <= window:
                starts.append(0)
                lengths.append(n)
                crcs.append(zlib.crc32(last, zlib.crc32(data[a:b])))
                totals.append(n)
                continue
            for at in range(0, n, window):
                size = min(window, n - at)
                crc = zlib.crc32(data[a + 4 * at : min(b, a + 4 * (at + size))])
                starts.append(at)
                lengths.append(size)
                crcs.append(zlib.crc32(last, crc) if at + size == n else crc)
                totals.append(n)
        self.docs.append(docs.take(pa.array(np.repeat(np.arange(len(docs)), -(-total // window)))))
        self.held += len(docs)

    def packed(self, window: int, base: int) -> tuple[int, pa.RecordBatch]:
        """The number of windows, and the pieces with their places."""
        starts, lengths, crcs, totals = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in self.numbers)
        where, offset, count = best_fit_decreasing(lengths, window)
        docs = pa.concat_arrays(self.docs) if self.docs else pa.array([], pa.int64())
        return count, pa.RecordBatch.from_arrays([docs, *map(pa.array, (starts, lengths, crcs, totals, where + base, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _packed(path: str | None, window: int, end: int, shard: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = _tokens(path or public_tokenizers.path("word_bpe_49k.json"))
        done, context, pieces = 0, TaskContext.get(), Pieces()
        base = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for part in slices(batch, SLICE):
                pieces.add(part.column(0), *tokens.encode(part.column(1)), window, int(end))
                if pieces.held >= shard:
                    count, out = pieces.packed(window, base + done)
                    yield out
                    done, pieces = done + count, Pieces()
        if pieces.held:
            yield pieces.packed(window, base + done)[1]

    return rows


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, shard: int = SHARD) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer file at `path` (by default the public word BPE),
    then `end`. A null or empty text is the end token alone. Every id lies in one piece, and the
    pieces of a sequence follow each other from offset 0 without a gap. Rows that repeat a
    doc_id, or have none, are packed each by itself; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(released(_packed(path, window, end, shard)), SCHEMA)
