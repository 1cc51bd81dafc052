import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import words as W
from gridloom.llm.superminhash import signatures


@pytest.mark.parametrize("slab", [7, 1 << 17])
def test_words_are_those_of_a_byte_split(monkeypatch, slab):
    monkeypatch.setattr(W, "SLAB", slab)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list(" \t\n\x0b\x0c\r\x1c\x85\xa0abcDEé漢"), rng.integers(0, 40))) for _ in range(500)] + [None, "", "  ", "x" * 100]
    got, seen = W.words_of(pa.array(texts)), {}
    for i, text in enumerate(texts):
        own = (text or "").encode().split()
        lo, hi = got.first[i], got.first[i + 1]
        assert hi - lo == len(own)
        for k, word in enumerate(own):
            assert got.data[got.starts[lo + k] : got.ends[lo + k]].tobytes() == word
            assert seen.setdefault(word, got.hashes[lo + k]) == got.hashes[lo + k]
    assert len(set(seen.values())) == len(seen)


def test_lower_case_is_that_of_a_to_z():
    a, b = (W.words_of(pa.array([t]), True).hashes for t in ("ABC É", "abc É"))
    assert (a == b).all() and (W.words_of(pa.array(["é"]), True).hashes != a[1]).all()


def test_a_slice_of_a_column_is_read_as_itself():
    column = pa.array(["a b", None, "c", "d e f"])
    assert W.words_of(column.slice(2)).counts.tolist() == [1, 3]
    assert W.words_of(column.slice(4)).counts.tolist() == []


def test_superminhash_estimates_without_bias():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        pool = rng.integers(0, 2**63, 150).astype(np.uint64)
        a, b = pool[:120], pool[30:]
        sig = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 128)
        errors.append((sig[0] == sig[1]).mean() - 90 / 150)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < np.sqrt(0.6 * 0.4 / 128)
    assert (signatures(np.zeros(0, np.uint64), np.array([0, 0]), 64) == 0).all()
