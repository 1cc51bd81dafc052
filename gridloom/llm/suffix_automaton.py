"""Suffix automata of a bounded reference: documents stream past them and lose what they share with it.

For references that have a size bound, such as benchmark passages. The reference is cut into shards of
whole texts, each shard's automaton is broadcast, and every document is streamed through all of
them for its matching statistics.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.words import slices

#: Words of a shard, and of all shards together; a larger reference is refused.
SHARD, MOST = 200_000, 5_000_000


class SuffixAutomaton:
    """The automaton of all factors of some word sequences; symbols are any hashable values."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, text: Iterable) -> None:
        """Adds a sequence; what earlier ones share with it is not made again."""
        last = 0
        for symbol in text:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
            last = new

    def matches(self, text: Iterable) -> Iterator[int]:
        """Matching statistics: for each place the length of the longest factor that ends there."""
        at = long = 0
        for symbol in text:
            while at and symbol not in self.next[at]:
                at = self.link[at]
                long = self.length[at]
            if symbol in self.next[at]:
                at, long = self.next[at][symbol], long + 1
            yield long


def shared_words(automata: list[SuffixAutomaton], words: list, least: int) -> np.ndarray:
    """Which words lie in a run of `least` words or more that some automaton has."""
    delta = np.zeros(len(words) + 1, np.int64)
    for a in automata:
        for i, n in enumerate(a.matches(words)):
            if n >= least:
                delta[i + 1 - n] += 1
                delta[i + 1] -= 1
    return np.cumsum(delta[:-1]) > 0


def remove_reference_spans(docs: DataFrame, reference: DataFrame, least: int = 50, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """docs (doc_id, text, ...) as doc_id, text, n_removed, without maximal spans of `least` words or more of reference.text.

    A text that loses words becomes its kept words joined by one space; others, null and empty ones
    too, stay as they are. A reference of more than `most` words is refused, so that what is broadcast has a bound.
    """
    spark, shards, held, total = docs.sparkSession, [SuffixAutomaton()], 0, 0
    for row in reference.select("text").where("text is not null").orderBy("text").toLocalIterator():
        words = row.text.encode().split()
        total += len(words)
        if total > most:
            raise ValueError(f"the reference has more than {most} words")
        if held and held + len(words) > shard:
            shards.append(SuffixAutomaton())
            held = 0
        shards[-1].add(words)
        held += len(words)
    shared = [spark.sparkContext.broadcast(s) for s in shards]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [s.value for s in shared]
        for batch in batches:
            for part in slices(batch):
                out, gone = [], []
                for text in part.column(1).to_pylist():
                    words = (text or "").encode().split()
                    hit = shared_words(automata, words, least)
                    gone.append(int(hit.sum()))
                    out.append(b" ".join([w for w, h in zip(words, hit.tolist(), strict=True) if not h]).decode() if gone[-1] else text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_removed"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, text string, n_removed long")
