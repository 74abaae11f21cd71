"""Jaccard join, substring dedup, neighbours, archives and the pipeline against brute force."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import ann, jaccard_join, packing, substring_dedup, warc
from gridloom.llm.components import components
from gridloom.llm.words import shingles as word_shingles
from gridloom.llm.words import word_hashes

ODD = [None, "", " \n", "a b", "A  B", "one two three four five", "x " * 4000]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], sets


def edited(text, seed, n):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.random()}"
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(docs_of, words, seed):
    texts = list(ODD)
    line = words(12, 99)
    for k in range(12):
        base = words(80 + 7 * k, 100 * seed + k)
        texts += [base, base.upper(), *(edited(base, s, e) for s in range(9) for e in (1, 2, 3, 4)), edited(edited(base, 3, 2), 4, 2)]
    texts += [f"{line} {words(20, 7000 + k)} {line}" for k in range(30)]
    want, sets = brute_components(texts)
    rows = jaccard_join.jaccard_components(docs_of(texts, clash=True)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want, strict=True))}
    kept = jaccard_join.one_of_each(docs_of(texts))
    assert {r.doc_id for r in kept.collect()} == set(want) and kept.columns == docs_of([]).columns


def test_more_buckets_than_tokens(docs_of, words, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_buckets", lambda docs: 1 << 30)
    texts = [*ODD, *(edited(words(80, 500 + k // 3), k, 1) for k in range(30)), *(words(70, 900 + k) for k in range(5))]
    want, sets = brute_components(texts)
    rows = jaccard_join.jaccard_components(docs_of(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want, strict=True))}


def test_jaccard_empty(docs_of):
    assert jaccard_join.jaccard_components(docs_of([])).count() == 0
    assert {r.component_id for r in jaccard_join.jaccard_components(docs_of([None, "", None])).collect()} == {0, 1, 2}


def test_packing_of_tokens():
    a = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 500).astype(np.uint64))
    b = np.arange(500, dtype=np.uint32)
    x, y = jaccard_join._unpacked(jaccard_join._packed(a, b), np.uint64, np.uint32)
    assert (x == a).all() and (y == b).all()
    assert [len(z) for z in jaccard_join._unpacked(jaccard_join._packed(a[:0], b[:0]), np.uint64, np.uint32)] == [0, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=0, max_size=60), st.integers(1, 12))
def test_minima_of_windows(values, least):
    v = np.array(values, np.uint64) << np.uint64(30)
    got = substring_dedup.window_minima(v, least).tolist()
    assert got == [min(range(s, s + least), key=lambda k: (values[k], k)) for s in range(len(values) - least + 1)]


def test_passages(docs_of, words):
    texts = list(ODD)
    shared = [words(n, 50 + n) for n in (50, 60, 130, 49)]
    for k in range(60):
        parts = [words(30 + k, 900 + k)]
        parts += [shared[k % 4], words(25, 2000 + k)] if k % 3 else []
        texts.append(" ".join(parts))
    texts.append(edited(shared[2], 5, 1))
    first: dict = {}
    covered = {}
    for i, t in enumerate(texts):
        w, own, c = words_of(t), set(), set()
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if g in first and first[g] != i:
                c |= set(range(k, k + 50))
            own.add(g)
        for g in own:
            first.setdefault(g, i)
        covered[i] = c
    rows = {r.doc_id: r for r in substring_dedup.passage_report(docs_of(texts, clash=True)).collect()}
    assert len(rows) == len(texts)
    for i, c in covered.items():
        got = {x for p in rows[i].spans.split(",") if p for x in range(*map(int, p.split(":")))}
        assert c <= got and (not got or c or i == len(texts) - 1), i
        assert (rows[i].component_id < i) == bool(got)
    assert rows[len(texts) - 1].n_spans >= 1
    out = substring_dedup.without_repeats(docs_of(texts, clash=True))
    assert out.columns == docs_of([], clash=True).columns
    left = {r.doc_id: r.text for r in out.collect()}
    for i, c in covered.items():
        if not c and i < len(texts) - 1:
            assert left[i] == texts[i]
        elif c and i in left:
            assert len(words_of(left[i])) <= len(words_of(texts[i])) - len(c)
    assert substring_dedup.passage_report(docs_of([])).count() == 0


@pytest.mark.parametrize("place", [3, 48])
def test_passage_with_an_edit_near_an_end(docs_of, words, place):
    w = words(52, 71).split()
    other = [*w[:place], "changed", *w[place + 1 :]]
    texts = [" ".join([words(40, 72 + k), *x, words(40, 75 + k)]) for k, x in enumerate((w, other))]
    rows = {r.doc_id: r for r in substring_dedup.passage_report(docs_of(texts)).collect()}
    assert rows[1].component_id == 0 and rows[1].spans == "40:92"


def test_similar_windows_share_a_key(words):
    """Planted passages of 50 words at J = 0.8: one word changed, put in or left out."""
    assert substring_dedup.shared_in_a_row(46) == 21
    for k in range(150):
        w, at = words(50, 7000 + k).split(), 5 + k % 40
        other = [[*w[:at], "changed", *w[at + 1 :]], [*w[:at], "more", *w[at:-1]], [*w[:at], *w[at + 1 :], "end"]][k % 3]
        texts = pa.array([" ".join([words(30, 8000 + 2 * k + i), *x, words(30, 9000 + 2 * k + i)]) for i, x in enumerate((w, other))])
        key, own, *_ = substring_dedup.compact_windows(*word_shingles(*word_hashes(texts)), 46)
        assert set(key[own == 0]) & set(key[own == 1]), k


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=60), st.integers(1, 12))
def test_minima_of_windows_are_the_tree_nodes_that_span_as_many(values, t):
    """A Cartesian tree by recursion: nodes (left, node, right) of t places or more."""
    nodes = set()

    def tree(left, right):
        if right - left >= t:
            node = min(range(left, right), key=lambda k: (values[k], k))
            nodes.add(node)
            tree(left, node)
            tree(node + 1, right)

    tree(0, len(values))
    assert nodes == set(substring_dedup.window_minima(np.array(values, np.uint64) << np.uint64(30), t).tolist())


def near(a, b, least=46, ends=True):
    """Whether some 50 words of ``a`` are similar to a passage of ``b`` (end to end, if ``ends``): by every pair of places."""
    x, y = ([tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in (a, b))
    for i in range(len(x) - least + 1):
        for j in range(len(y) - least + 1):
            both = set(x[i : i + least]) & set(y[j : j + least])
            if 100 * len(both) >= 80 * (2 * least - len(both)) and (not ends or x[i] in both and x[i + least - 1] in both):
                return True
    return False


def test_near_copies_of_passages_whatever_the_partitions(spark, words):
    """Families of a passage and copies with one word changed each, the passage itself not first: every later one is found."""
    texts, family = [], []
    for k in range(50):
        w = words(60, 20_000 + k).split()
        places = random.Random(k).sample(range(60), 3)
        for n, at in enumerate((places[0], None, *places[1:])):
            passage = [f"other{k}x{i}" if i == at else x for i, x in enumerate(w)]
            texts.append(" ".join([words(30, 30_000 + 4 * k + n), *passage, words(30, 40_000 + 4 * k + n)]))
            family.append(passage)
    deal = random.Random(5).sample(range(len(texts)), len(texts))
    want = {}
    for i in range(len(texts)):
        k = i // 4 * 4
        want[i] = any(near(family[i], family[j]) for j in range(k, k + 4) if deal[j] < deal[i])
    docs = spark.createDataFrame([(deal[i], t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = []
    for parts in (1, 7, 40):
        rows = {r.doc_id: r for r in substring_dedup.passage_report(docs.repartition(parts)).collect()}
        assert {i for i in want if want[i]} <= {i for i in want if rows[deal[i]].n_spans}
        for k in range(0, len(texts), 4):
            if all(near(family[k + 1], family[j]) for j in (k, k + 2, k + 3)):
                assert {rows[deal[j]].component_id for j in range(k, k + 4)} == {min(deal[k : k + 4])}
        seen.append(rows)
    assert seen[0] == seen[1] == seen[2]


def test_no_link_between_classes_is_lost(spark, words):
    """Chains D ~ B ~ C ~ E of 50-word passages, the smaller documents at the ends, and random families: the components of all pairs."""
    families = []
    for k in range(10):
        b = words(50, 60_000 + k).split()
        change = lambda w, at, k=k: [f"new{k}x{at}" if i == at else x for i, x in enumerate(w)]
        c = change(b, 10)
        families.append([change(b, 12), change(c, 45), b, c])
    for k in range(12):
        r, w = random.Random(k), words(60, 70_000 + k).split()
        families.append([[f"{k}y{n}z{i}" if i in at else x for i, x in enumerate(w)] for n, at in enumerate(set(r.sample(range(8, 52), r.randint(1, 3))) for _ in range(7))])
    rows, want, n = [], [{}, {}], 0
    for family in families:
        ids = list(range(n, n + len(family)))
        rows += [(i, " ".join([words(30, 80_000 + i), *w, words(30, 90_000 + i)])) for i, w in zip(ids, family)]
        for ends in (False, True):
            root = dict(zip(ids, ids))
            for i in range(len(family)):
                for j in range(i):
                    if near(family[i], family[j], ends=ends):
                        a, b = root[ids[i]], root[ids[j]]
                        root = {x: min(a, b) if y in (a, b) else y for x, y in root.items()}
            want[ends] |= root
        n += len(family)
    # What is cut back to shared ends may be shorter than a passage: then, and only then, a link need not be.
    loose, strict = want
    assert sum(loose[i] != strict[i] for i in range(40, n)) < 10 and all(loose[i] == i // 4 * 4 for i in range(40))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7, 40):
        got = {r.doc_id: r.component_id for r in substring_dedup.passage_report(docs.repartition(parts)).collect()}
        assert all(got[i] == loose[i] for i in range(n) if i < 40 or loose[i] == strict[i]), parts
        assert all(got[i] == got[strict[i]] and loose[got[i]] == loose[i] for i in range(n)), parts


def test_groups_come_out_document_by_document():
    """Rows of a partition leave once their document is complete: some batches are held, never a partition."""
    most, taken = 0, 0

    def batches():
        nonlocal taken
        for k in range(40):
            taken += 1
            ids = [k, k]
            yield pa.RecordBatch.from_pydict({"id": ids, "kind": pa.array([0, 1], pa.int32()), "text": ["w%d " % k * 300_000, None]})

    out = 0
    for words, asks in substring_dedup._groups(batches(), ("id",)):
        out += asks.num_rows
        most = max(most, taken - out)
        assert set(words) == set(asks.column("id").to_pylist())
    assert out == 40 and most <= 3


def test_rows_of_one_document(spark, words):
    """Rows that share a doc_id are one document, with the largest of their texts; other rows of it stay as they are."""
    p, a, b = words(60, 1), words(40, 2), words(40, 3)
    rows = [(1, f"{a} {p}"), (2, f"a {p}"), (2, f"z {b} {p}"), (3, "of " * 90), (4, "of " * 300), (4, "of " * 300), (None, p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    report = [(r.doc_id, r.spans) for r in substring_dedup.passage_report(docs).orderBy("doc_id").collect()]
    assert report == [(None, ""), (1, ""), (2, "41:101"), (2, "41:101"), (3, ""), (4, "0:300"), (4, "0:300")]
    left = sorted((r.doc_id or 0, r.text) for r in substring_dedup.without_repeats(docs).collect())
    assert left == [(0, p), (1, f"{a} {p}"), (2, f"a {p}"), (2, f"z {b} "), (3, "of " * 90)]


def test_a_leader_that_is_not_similar_hides_no_repeat(docs_of, words):
    """Documents before an exact repeat hold variants of it with words changed far apart."""
    texts, pairs = [], []
    for k in range(40):
        w = words(50, 300 + k).split()
        for at in ((8, 40), (16, 33), (2, 25, 47)):
            variant = [f"other{i}" if i in at else x for i, x in enumerate(w)]
            texts.append(" ".join([words(30, 4000 + len(texts)), *variant, words(30, 6000 + len(texts))]))
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join([words(30, 4000 + i), *w, words(30, 6000 + i)]) for i in pairs[-1]]
    rows = {r.doc_id: r for r in substring_dedup.passage_report(docs_of(texts).coalesce(1)).collect()}
    assert [rows[b].spans for _, b in pairs] == ["30:80"] * len(pairs)
    assert all(rows[b].component_id == a for a, b in pairs)


def test_cut_text():
    assert substring_dedup.cut_text("a b  c d", [(1, 3)]) == "a d" and substring_dedup.cut_text("a b", [(0, 2)]) == ""


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
def test_components(spark, links):
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for e in links if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_neighbours(spark):
    """Brute force, with repeated ids as queries and as candidates, and rows that take no part; other columns may have any name."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(304, 16)).astype(np.float32)
    x[7] = x[8]
    ids = [*range(300), 20, 20, 33, 33]
    x[301] = x[20]
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)]
    rows += [(300, None, 0), (320, [0.0] * 16, 0), (340, [float("nan")] * 16, 0), (360, [None] + [1.0] * 15, 0), (400, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (500, [], 0)]
    rows += [(380, [1.0] * 4, 0), (380, [1.0] * 4, 1), (381, [2.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.selectExpr("*", *(f"'x' as {c}" for c in ("row", "q", "c", "dim", "ids", "part", "vector", "score")))
    d = x.astype(float) @ x.astype(float).T
    want = {}
    for q in range(304):
        if ids[q] % 20 == 0:
            want.setdefault(ids[q], []).append([(ids[j], s) for s, j in sorted((-d[q, j], ids[j] * 1000 + j) for j in range(304) if j != q)[:20] for j in [j % 1000]])
    want[380] = [[(381, -8.0), (380, -4.0)]] * 2
    for parts in (1, 4):
        got: dict = {}
        for r in ann.nearest(df.repartition(parts), block=64).collect():
            got.setdefault(r.query_id, []).append(r)
        assert set(got) == set(want)
        for q, lists in want.items():
            found = sorted((r["rank"], r.vec_id, round(r.score, 9)) for r in got[q])
            assert found == sorted((k, v, round(-s, 9)) for own in lists for k, (v, s) in enumerate(own, 1)), q
    assert ann.nearest(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big, small = "<p>" + "é" * 800, "tiny"
    html = [big, big, small, small, None, "", "z" * 999, "z" * 999, big + "x", big]
    pages = spark.createDataFrame([(i, f"http://e/{i}", h) for i, h in enumerate(html)] + [(None, None, big), (9, "http://again", big)], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'x' as digest", "1 as n")
    rows = warc.archived_pages(pages).collect()
    assert len(rows) == 12
    for r in rows:
        raw = ((html[r.page_id] if r.page_id is not None else big) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        copies = [i for i, h in enumerate(html) if (h or "").encode() == raw]
        revisit = len(raw) >= 1000 and (r.page_id is None or r.page_id < max(copies))
        assert (r.record_type, r.refers_to) == (("revisit", max(copies)) if revisit else ("response", None))
    path = str(tmp_path / "w")
    warc.write_pages(pages, path)
    found = spark.read.format("warc").load(path)
    assert found.where("record_type = 'revisit'").count() == 3
    assert found.where("record_id = 'urn:page:3'").select("payload").first()[0] == small.encode()
    assert found.where("payload_length >= 1000 and record_type in ('response')").count() == 3
    one = next(p for p in (tmp_path / "w").iterdir() if p.suffix == ".gz")
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.warc").write_bytes(gzip.decompress(one.read_bytes()))
    (plain / "b.warc.gz").write_bytes(gzip.compress(gzip.decompress(one.read_bytes())))
    assert spark.read.format("warc").load(str(plain)).count() == 2 * spark.read.format("warc").load(str(one)).count()
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_warc_long_headers(spark, tmp_path):
    """Headers longer than what is inflated at once, whether their bytes compress well or not."""
    r = random.Random(4)
    urls = ["http://e/" + "u" * 100_000, "http://e/" + "".join(r.choice("abcdefgh0123456789%") for _ in range(100_000)), "http://e/" + "v" * 5_000, "http://e/" + "w" * 4_090]
    html = ["p" * 1600, "", "p" * 1600, "<b>" + "q" * 50_000]
    rows = [(i, u, h) for i, (u, h) in enumerate((u, h) for u in urls for h in html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x for x in warc.archived_pages(pages).collect()}
    last = {h: i for i, _, h in rows}
    for i, _, h in rows:
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(h), hashlib.sha1(h.encode()).hexdigest())
        assert got[i].refers_to == (last[h] if len(h) >= 1000 and i != last[h] else None)
    path = str(tmp_path / "w")
    warc.write_pages(pages, path)
    assert sorted(x.target_uri for x in spark.read.format("warc").load(path).collect()) == sorted(u for _, u, _ in rows)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "a.warc.gz").write_bytes(warc.member(b"WARC/1.1\r\nWARC-Type: response\r\n"))
    with pytest.raises(Exception, match="have no end"):
        spark.read.format("warc").load(str(tmp_path / "broken")).collect()


def test_warc_of_others(spark, tmp_path):
    """Archives without this writer's headers give the same rows with filters pushed down and without."""
    record = lambda k, kind, n: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{k}>\r\nContent-Type: text/plain\r\nContent-Length: {n}\r\n\r\n{'z' * n}\r\n\r\n".encode()
    data = b"".join(record(k, ("response", "resource")[k % 2], 500 * k) for k in range(6))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    warc.register(spark)
    read = spark.read.format("warc").load(str(tmp_path))
    rows = read.collect()
    assert len(rows) == 12
    for text, keep in [
        ("payload_length >= 1000", lambda x: x.payload_length >= 1000), ("payload_length = 1500", lambda x: x.payload_length == 1500), ("record_type = 'resource'", lambda x: x.record_type == "resource"),
        ("target_uri is not null", lambda x: x.target_uri is not None), ("target_uri is null", lambda x: x.target_uri is None), ("record_id in ('urn:x:1', 'urn:x:2')", lambda x: x.record_id in ("urn:x:1", "urn:x:2")),
        ("record_id >= 'urn:x:4'", lambda x: x.record_id >= "urn:x:4"), ("record_id like 'urn:x%' and payload_length <= 500", lambda x: x.payload_length <= 500),
    ]:
        assert sorted((x.record_id, x.payload_length) for x in read.where(text).select("record_id", "payload_length").collect()) == sorted((x.record_id, x.payload_length) for x in rows if keep(x)), text


def test_pipeline(spark, docs_of, words, tmp_path):
    texts = [*ODD[:6], *(words(90, 40 + k) for k in range(30))]
    texts += [texts[10], edited(texts[11], 1, 1), words(20, 1) + " " + texts[12][: len(texts[12]) * 3 // 4] + " " + words(90, 2), "password = abcdefghijklmnop " + words(30, 3)]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs_of([]).columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    # Each stage by plain means: all texts are clean; the smallest of each component; one passage of 38 stands in 12 first; one secret.
    want, _ = brute_components(texts)
    expected = dict(enumerate(texts))
    assert kept["toxicity"] == expected
    expected = {i: t for i, t in expected.items() if i in set(want)}
    assert kept["ngram_jaccard_join"] == expected and {36, 37}.isdisjoint(want)
    w, other = texts[38].split(), texts[12].split()
    shared = next(k for k in range(len(other)) if w[20 + k] != other[k])
    assert shared >= 50
    expected[38] = " ".join(w[:20] + w[20 + shared :])
    assert kept["substring_dedup"] == expected
    expected[39] = "<assign> " + words(30, 3)
    assert kept["secret_scans"] == expected
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in expected.items()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(
        (i, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(np.array(x[k : k + 4096], "<u4").tobytes())) for i, x in ids.items() for k in range(0, len(x), 4096)
    )
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in s) == max(a + n for a, n in s) <= 4096 for s in used.values()) and len(used) == -(-sum(map(len, ids.values())) // 4096)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "secret_scans", "best_fit_packing"]
