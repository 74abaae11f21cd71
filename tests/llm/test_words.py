import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import shared, words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b\x0c\x1cé", max_size=20)), max_size=6))
def test_split(texts):
    offsets, values = words.split(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    assert [values[a:b].to_pylist() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)] == want
    so, sh = words.shingles(*words.word_hashes(pa.array(texts, pa.string())))
    assert np.diff(so).tolist() == [max(len(w) - 4, min(len(w), 1)) for w in want]
    seen: dict = {}
    for i, w in enumerate(want):
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        for g, h in zip(grams, sh[so[i] : so[i + 1]].tolist(), strict=True):
            assert seen.setdefault(g, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    values = pa.array(["a", "bb" * 300, "c", "d" * 999, "e" * 64, "f" * 65])
    whole = words.hash_words(values)
    monkeypatch.setattr(words, "_AT_ONCE", 64)
    assert (words.hash_words(values) == whole).all() and (words.hash_words(values.slice(1, 3)) == whole[1:4]).all()


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 12, 3, 3, 3)] + [None])], names=["text"])
    parts = list(shared.slices(iter([batch, batch.slice(0, 0)]), "text", 6))
    assert [p.num_rows for p in parts] == [2, 1, 2, 2] and sum(p.num_rows for p in parts) == 7
