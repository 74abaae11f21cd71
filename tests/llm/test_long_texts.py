"""Texts of a megabyte and more through the operators, beside short ones."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import jaccard_join, lm_scoring, packing, substring_dedup, telephony, toxicity, warc


@pytest.fixture(scope="module")
def texts(words):
    prose = words(130_000, 1)
    assert len(prose) > 1_000_000
    return [prose, "x" * 1_500_000, "of " * 400_000, words(40, 2) + " " + prose, words(60, 3), None, "é" * 700_000 + " b"]


def test_passages(docs_of, texts):
    rows = {r.doc_id: r for r in substring_dedup.passage_report(docs_of(texts)).collect()}
    n = len(texts[0].split())
    assert [rows[i].component_id for i in range(7)] == [0, 1, 2, 0, 4, 5, 6]
    assert rows[3].spans == f"40:{40 + n}" and all(rows[i].n_spans == 0 for i in (0, 1, 2, 4, 5, 6))


def test_sets(docs_of, texts):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs_of(texts)).collect()}
    sets = [len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) > 4 else min(len(w), 1) for w in ((t or "").split() for t in texts)]
    assert rows == {i: (sets[i], 0 if i == 3 else i) for i in range(7)}


def test_packing(docs_of, texts):
    path = public_tokenizers.path(packing.TOKENIZER)
    rows = packing.pack_documents(docs_of(texts), path).collect()
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == i)
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        assert own == [(k // 4096, k, min(4096, n - k)) for k in range(0, n, 4096)], i


def test_scores(docs_of, texts):
    lexicon = toxicity.Lexicon(words={"kalomi": 3.0}, near={"kalomi": 2.0}, base=-1.0, rate=1e-6)
    rows = {r.doc_id: r.score for r in toxicity.scored(docs_of(texts), lexicon).collect()}
    assert len(rows) == 7 and all(0 <= s <= 1 for s in rows.values()) and rows[5] == pytest.approx(1 / (1 + np.exp(1.0)))
    lm = {r.doc_id: r for r in lm_scoring.lm_scores(docs_of(texts)).collect()}
    assert all(lm[i].n_tokens == len((t or "").split()) + 1 and np.isfinite(lm[i].score) for i, t in enumerate(texts))


def test_stored_forms(spark, docs_of, texts):
    for r in telephony.audio_columns(docs_of(texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
    pages = spark.createDataFrame([(i, f"http://e/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    for r in warc.archived_pages(pages).collect():
        raw = (texts[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(raw), hashlib.sha1(raw).hexdigest(), "response")
