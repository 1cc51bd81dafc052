import random

import pytest

from gridloom.llm.suffix_automaton import SuffixAutomaton, remove_reference_spans, shared_words
from tests.llm.helpers import SCHEMA


def test_matching_statistics_equal_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(3)]
        a = SuffixAutomaton()
        for t in texts:
            a.add(t)
        factors = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        query = [rng.choice("abcd") for _ in range(30)]
        want = [max((n for n in range(1, i + 2) if tuple(query[i + 1 - n : i + 1]) in factors), default=0) for i in range(30)]
        assert list(a.matches(query)) == want
        covered = [any(tuple(query[s : s + 4]) in factors for s in range(max(0, i - 3), i + 1) if s + 4 <= 30) for i in range(30)]
        assert shared_words([a], query, 4).tolist() == covered


def test_spans_of_a_reference_go(spark):
    passage = [f"w{i}" for i in range(60)]
    rows = [(1, "a b " + " ".join(passage) + " c", "", "", 0), (2, " ".join(passage[:49]) + "  x", "", "", 0), (3, None, "", "", 0), (4, "", "", "", 0), (None, " ".join(passage[5:55]), "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    reference = spark.createDataFrame([(" ".join(passage),), ("other words",), (None,)], "text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in remove_reference_spans(docs, reference, shard=10).collect()}
    assert got == {1: ("a b c", 60), 2: (rows[1][1], 0), 3: (None, 0), 4: ("", 0), None: ("", 50)}
    assert remove_reference_spans(docs.limit(0), reference).count() == 0
    with pytest.raises(ValueError):
        remove_reference_spans(docs, reference, most=10)
