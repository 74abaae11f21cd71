"""Periodic runs against a plain search of every lag, at small and large thresholds of frequent words."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import periodic_runs


def all_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            e = i + q
            if i > s and e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def offsets_and_codes(texts):
    return np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64), np.array([c for t in texts for c in t], np.int64)


@pytest.mark.parametrize("heavy", [3.0, 1e9])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(0, 9), st.lists(st.integers(0, 2), max_size=12)), max_size=3))
def test_runs_of(heavy, parts):
    texts = [a + p * k + b for a, p, k, b in parts]
    was, periodic_runs._heavy = periodic_runs._heavy, lambda sizes: np.full(len(sizes), heavy)
    try:
        assert periodic_runs.runs_of(*offsets_and_codes(texts)) == [all_runs(t) for t in texts]
    finally:
        periodic_runs._heavy = was


def test_lag_counts_are_exact():
    r = random.Random(5)
    texts = [[min(int(r.paretovariate(0.7)), 50) for _ in range(n)] for n in (0, 1, 900, 4000)]
    counts, bases = periodic_runs.lag_counts(*offsets_and_codes(texts))
    for t, base in zip(texts, bases):
        for q in range(1, len(t) // 4 + 1):
            assert counts[base + q] == sum(x == y for x, y in zip(t, t[q:]))


def test_a_million_words():
    one, two = np.zeros(1_000_000, np.int64), np.arange(1_000_000) % 5000
    assert periodic_runs.runs_of(np.array([0, len(one)]), one) == [[(0, 1_000_000, 1)]]
    assert periodic_runs.runs_of(np.array([0, len(two)]), two) == [[(0, 1_000_000, 5000)]]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_report(docs_of, words):
    r = random.Random(2)
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "é é é é é é é é", "x" * 300_000, "z" * 100_000 + (" " + "z" * 100_000) * 6, "one two " * 20_000]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(5, 80))) for _ in range(80)]
    texts += [words(30, i) + " " + (words(r.randint(1, 12), i + 1) + " ") * r.randint(3, 6) + words(20, i + 2) for i in range(80)]
    got = {x.doc_id: tuple(x)[1:] for x in periodic_runs.run_report(docs_of(texts, clash=True)).collect()}
    assert got == {i: expected(i, t) for i, t in enumerate(texts)}


def test_rows_without_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b a b a b a b"), (3, "c c c c c c"), (3, "c c c c c c")], "doc_id long, text string")
    out = sorted((x.doc_id is None, x.runs, x.collapsed) for x in periodic_runs.find_runs(periodic_runs.planted(docs)).collect())
    assert [(a, [tuple(r) for r in runs], text) for a, runs, text in out] == [(False, [(0, 6, 1)], "c")] * 2 + [(True, [(0, 8, 2)], "a b")]
