"""Substring dedup: near-duplicate passages by compact windows.

A text is the sequence of its 5-word shingles; hash functions order them. In the
Cartesian tree of one function's values, a node is the minimum of every subsequence
within its span that holds it: one compact window (left end, node, right end) stands
for all of them. The nodes that span ``t`` places or more are the minima of the
sliding windows of that length, and are found as such, without the rest of the tree; a
shingle that recurs within t places is one node. Joining the windows of two functions by overlap
gives the subsequences of ``t`` shingles that share both minima: their signature, the
two shingles, is a key.

How short windows must be so that no similar passage is missed follows from the
similarity: a stretch of ``least`` shingles that is similar has lost five at most (of
46, at 0.8), a word changed, put in or left out costs four or more, so 21 in a row
are shared. With t = 21 all functions agree on some window of them: every similar
pair of passages has a key in common, by rule and not by chance.

1. Documents of equal words are found by a key of all their words; the smallest one
   stands for them. Windows of other documents with one key are candidates. Each meets the key's
   leader, the first window of its smallest document. Tasks combine their own windows
   of a key before the shuffle and send on one document's alone; the rest learn the
   leader from that one, so results do not depend on how rows are dealt.
2. Candidates of a pair of documents join to intervals by place and diagonal. The
   leader's words there, cut from its text once, meet the document's own text and are
   verified shingle by shingle (by hashes of 32 bits a word): a stretch of ``least``
   shingles counts where it reaches the similarity, and its ends are cut back to what
   both hold.
3. What the passages found link are classes of documents. A window that no passage
   covers, and all windows of a key whose documents are of several classes, meet the
   others of their key by their words: shingles that several documents of the key hold
   bound the overlap, what reaches the bound is verified. One similar passage of a
   smaller document is enough for a window without any, and one for two classes; so
   components are those of all pairs of similar passages, though not all pairs are met.

Nulls, empty texts and texts under ``least`` shingles have no passages. Rows that
share a doc_id are one document, with the largest of their texts. A passage repeated
within one document alone does not count. Other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import give_back, id_text, remove, slices, written
from .words import SHINGLE, mix, shingles, word_hashes

LEAST_WORDS = 50
SIMILAR = 80  # in a hundred
SLICE = 1 << 20  # bytes of text whose windows are made at once
MANY = 5_000  # windows that meet a leader in one task; more, if a thousandth of all is more
_PLACE = np.uint64((1 << 28) - 1)
_WIDE = 28  # bits of a window's width
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def window_minima(values: np.ndarray, least: int) -> np.ndarray:
    """Place of the minimum of each window of ``least`` values; the first of equal ones."""
    n = len(values)
    if n < least:
        return np.zeros(0, np.int64)
    keyed = (values & ~_PLACE) | np.arange(n, dtype=np.uint64)
    full = -(-n // least) * least
    blocks = np.full(full, ~np.uint64(0))
    blocks[:n] = keyed
    blocks = blocks.reshape(-1, least)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[: n - least + 1], before[least - 1 : n]) & _PLACE).astype(np.int64)


def shared_at_least(least: int, similar: int = SIMILAR) -> int:
    """Shingles of ``least`` that a similar stretch has in common: equal sizes, so J = i / (2 n - i)."""
    return -(-2 * similar * least // (100 + similar))


def shared_in_a_row(least: int, similar: int = SIMILAR) -> int:
    """Shingles in a row that a similar stretch shares at least.

    A break (a word changed, put in or left out) costs SHINGLE - 1 shingles or more.
    """
    enough = shared_at_least(least, similar)
    return -(-enough // ((least - enough) // (SHINGLE - 1) + 1))


def compact_windows(offsets: np.ndarray, hashes: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(key, text, start, end) of the windows that share two functions' minima.

    Start and end enclose both minima; places count from the text's first shingle.
    """
    t = shared_in_a_row(least)
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - t + 1
    inside = np.flatnonzero((text[:n] == text[t - 1 :]) & (counts[text[:n]] >= least)) if n > 0 else np.zeros(0, np.int64)
    if not len(inside):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    node = _recurrences(text, hashes, t)
    a, b = (window_minima(mix(hashes ^ np.uint64(0xA5A5A5A5 * (j + 1))), t)[inside] for j in range(2))
    # Runs of starts: within one text, one minimum of either function.
    own = text[inside]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(node[a]) != 0) | (np.diff(node[b]) != 0) | (np.diff(own) != 0))))
    start, end = np.minimum.reduceat(np.minimum(a, b), first), np.maximum.reduceat(np.maximum(a, b), first) + 1
    a, b, own = a[first], b[first], own[first]
    with np.errstate(over="ignore"):
        key = mix(hashes[a] * np.uint64(3) + mix(hashes[b] + np.uint64(7)))
    return key, own, start - offsets[own], end - offsets[own]


def _recurrences(text: np.ndarray, hashes: np.ndarray, t: int) -> np.ndarray:
    """For each place the first of its shingle's places that lead to it by steps of less than ``t``: in repeated words and lines they are one node."""
    n = len(hashes)
    node = np.arange(n)
    for step in range(min(t - 1, n - 1), 0, -1):
        again = np.flatnonzero((hashes[step:] == hashes[:-step]) & (text[step:] == text[:-step])) + step
        node[again] = again - step
    back = np.flatnonzero(node != np.arange(n))
    while True:
        far = node[node[back]]
        if (far == node[back]).all():
            return node
        node[back] = far


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of sizes[i] each, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _one_text_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id and text of each document, and, where ids occur in several rows, these ids and a sign of the text that counts)."""
    texts = id_text(docs).where("doc_id is not null")
    again = texts.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return texts, None
    chosen = written(texts.join(again, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")), "chosen")
    rest = texts.join(chosen.select("doc_id"), "doc_id", "left_anti")
    return rest.unionByName(chosen), chosen.select("doc_id", F.sha2("text", 256).alias("sign"))


def _signs(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) for each text, by all its shingles in order: an odd key, and a place below zero with their number and more bits."""
    counts = np.diff(offsets)
    with np.errstate(over="ignore"):
        terms = np.append(mix(hashes + _flat(np.zeros(len(counts), np.int64), counts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
        sums = np.cumsum(terms)
        total = mix(sums[offsets[1:] - 1] - np.where(offsets[:-1] > 0, sums[offsets[:-1] - 1], np.uint64(0)) + counts.astype(np.uint64))
    return total | np.uint64(1), -1 - (counts << 20 | (mix(total) >> np.uint64(44)).astype(np.int64))


def _links(texts: DataFrame, least: int) -> DataFrame:
    """(key, doc, place, doc0, place0): windows and their key's leader, the first window of another document; without doc0: the leader's repeats.

    Documents of equal words have a key of their own, with places below zero.
    """
    schema = "part long, key long, doc long, place long, doc0 long, place0 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            offsets, hashes = shingles(*word_hashes(batch.column("text")))
            ids = batch.column("doc_id").to_numpy()
            key, own, start, end = compact_windows(offsets, hashes, least)
            sign, length = _signs(offsets, hashes)
            long = np.flatnonzero(np.diff(offsets) >= least)
            # Of texts of equal words, one document's windows are enough.
            order = long[np.lexsort((ids[long], length[long], sign[long]))]
            again = np.concatenate(([False], (np.diff(sign[order]) == 0) & (np.diff(length[order]) == 0))) if len(order) else np.zeros(0, bool)
            keep = np.ones(len(ids), bool)
            keep[order[again]] = False
            keep = keep[own]
            key = np.concatenate((key[keep] & ~np.uint64(1), sign[long]))
            doc = np.concatenate((ids[own[keep]], ids[long]))
            place = np.concatenate((start[keep] << _WIDE | end[keep] - start[keep], length[long]))
            order = np.lexsort((place, doc, key))
            key, doc, place = key[order].view(np.int64), doc[order], place[order]
            lead = np.maximum.accumulate(np.where(np.diff(key, prepend=~key[:1]) != 0, np.arange(len(key)), 0))
            # Windows of further documents stay out of the key's task; they go by the leader that they have here.
            held = doc != doc[lead]
            led = np.zeros(len(key), np.int64)
            led[lead[held]] = 1
            part = np.where(held, mix(key.view(np.uint64) + mix(doc[lead].view(np.uint64))).view(np.int64), key)
            yield _batch({"part": part, "key": key, "doc": doc, "place": place, "doc0": pa.array(doc[lead], mask=~held), "place0": np.where(held, place[lead], led)})

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a key in order of documents: the first leads; windows that have a leader pass."""
        last: tuple | None = None  # key, document and place of the leader
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column("doc0").is_valid().to_numpy(zero_copy_only=False)
            passed = batch.filter(pa.array(held))
            yield _batch({c: passed.column(c) for c in ("key", "doc", "place", "doc0", "place0")} | {"held": np.full(passed.num_rows, 2)})
            rows = batch.filter(pa.array(~held))
            key, doc, place, led = (rows.column(c).to_numpy() for c in ("key", "doc", "place", "place0"))
            if last is not None:
                key, doc, place, led = (np.append(np.int64(x), y) for x, y in zip((*last, 0), (key, doc, place, led), strict=True))
            if not len(key):
                continue
            lead = np.maximum.accumulate(np.where(np.diff(key, prepend=~key[:1]) != 0, np.arange(len(key)), 0))
            # A key's own repeats of its leader count only beside other documents; the next batch may hold those.
            other = doc != doc[lead]
            met = np.zeros(len(key), bool)
            met[lead[other]] = True
            met[lead[-1]] = True
            keep = other | (met[lead] & (np.arange(len(key)) != lead))
            if last is not None:
                keep[0] = False
            last = (key[-1], doc[lead[-1]], place[lead[-1]])
            doc0, place0 = pa.array(doc[lead][keep], mask=~other[keep]), pa.array(place[lead][keep], mask=~other[keep])
            yield _batch({"key": key[keep], "doc": doc[keep], "place": place[keep], "doc0": doc0, "place0": place0, "held": led[keep]})

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows after the one that led them in their task (held 1, if it has a leader itself): they take its leader."""
        last = np.zeros((0, 5), np.int64)
        for batch in batches:
            held = batch.column("held").to_numpy()
            rows = np.stack([batch.column(c).to_numpy() for c in ("key", "doc0", "place0", "doc", "place")], axis=1)
            n = len(last)
            rows, leads = np.concatenate((last, rows)), np.concatenate((np.ones(n, bool), held == 1))
            at = np.maximum.accumulate(np.where(leads, np.arange(len(rows)), -1))
            found = (at >= 0) & (rows[at, :3] == rows[:, :3]).all(axis=1)
            leader = np.where(found[:, None], rows[at, 3:], rows[:, 1:3])
            out = np.concatenate((rows[:, [0, 3, 4]], leader), axis=1)[~leads]
            yield _batch({c: out[:, i] for i, c in enumerate(("key", "doc", "place", "doc0", "place0"))})
            last = rows[at[-1] :][:1] if len(at) and at[-1] >= 0 else last

    columns = ["key", "doc", "place", "doc0", "place0"]
    dealt = texts.mapInArrow(run, schema).repartition("part").sortWithinPartitions("part", "key", "doc", "place")
    rows = written(dealt.mapInArrow(star, "key long, doc long, place long, doc0 long, place0 long, held long"), "windows")
    done, held = rows.where("held < 2").select(*columns), rows.where("held = 2")
    leaders = rows.where("held = 1 and doc0 is not null")
    leaders = leaders.select("key", F.col("doc0").alias("doc"), F.col("place0").alias("place"), F.col("doc").alias("doc0"), F.col("place").alias("place0"), "held")
    dealt = leaders.unionByName(held).repartition("key", "doc0").sortWithinPartitions("key", "doc0", "place0", "held", "doc", "place")
    links = written(done.unionByName(dealt.mapInArrow(follow, "key long, doc long, place long, doc0 long, place0 long")), "links")
    remove(rows.sparkSession, rows)
    return links


def _with_texts(texts: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with an id) and the texts of their ids, dealt by id and salt: each text (kind 0) comes before its rows, once."""
    names = [c for c in rows.columns if c not in ("id", "salt")]
    rows = rows.withColumns({"kind": F.lit(1), "text": F.lit(None).cast("string")})
    if "salt" in texts.columns:
        both, by = rows.unionByName(texts.withColumn("kind", F.lit(0)), allowMissingColumns=True), ("id", "salt")
    else:
        both, by = rows.unionByName(texts.select(F.col("doc_id").alias("id"), F.lit(0).alias("kind"), "text"), allowMissingColumns=True), ("id",)
    return both.repartition(*by).sortWithinPartitions(*by, "kind", *order).select("id", "kind", *names, "text")


def _groups(batches: Iterator[pa.RecordBatch], same: tuple[str, ...]) -> Iterator[tuple[dict[int, np.ndarray], pa.Table]]:
    """Of rows in order: (32-bit hashes of the words of the texts asked for, by id; the rows that ask). Rows that agree in ``same`` stay together."""
    held: list[pa.RecordBatch] = []
    text: pa.Table | None = None  # of the last id
    ended = False

    def out(rows: pa.Table) -> tuple[dict[int, np.ndarray], pa.Table]:
        nonlocal text
        asks = rows.filter(pc.equal(rows.column("kind"), 1)).drop_columns(["text"]).combine_chunks()
        texts = rows.filter(pc.equal(rows.column("kind"), 0)).select(["id", "text"])
        texts = texts if text is None else pa.concat_tables([text, texts])
        text = texts.slice(texts.num_rows - 1) if texts.num_rows else None
        words: dict[int, np.ndarray] = {}
        texts = texts.filter(pc.is_in(texts.column("id"), pc.unique(asks.column("id")))).combine_chunks()
        for part in slices(iter(texts.to_batches()), "text", SLICE):
            at, hashes = word_hashes(part.column("text"))
            hashes = hashes.astype(np.uint32)
            words |= {i: hashes[a:b] for i, a, b in zip(part.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)}
        return words, asks

    while not ended:
        batch = next(batches, None)
        ended = batch is None
        if not ended and batch.num_rows:
            held.append(batch)
        if not held or not ended and sum(b.nbytes for b in held) < 2 << 20:
            continue
        rows = pa.Table.from_batches(held)
        stop = rows.num_rows
        if not ended:
            # The last group may go on in the next batch; it is one document's at most.
            last = np.ones(stop, bool)
            for name in same:
                column = pc.fill_null(rows.column(name), -1).to_numpy()
                last &= column == column[-1]
            stop = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        if stop:
            yield out(rows.slice(0, stop))
        held = rows.slice(stop).to_batches()
    give_back()


def _intervals(pair: np.ndarray, start: np.ndarray, end: np.ndarray, start0: np.ndarray, end0: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(interval of each candidate, and pair, from, to, from0, to0 of each interval) of candidates in order of pair and start.

    Shingles from:to hold all stretches of ``least`` with a candidate in them, from0:to0 what such a stretch can be similar to.
    """
    low, high = start - (least - 1), end + (least - 1)
    shift = start0 - start
    reach = np.maximum.accumulate(pair * (1 << 40) + high)
    lost = least - shared_at_least(least)
    new = np.concatenate(([True], (np.diff(pair) != 0) | (pair[1:] * (1 << 40) + low[1:] > reach[:-1]) | (np.abs(np.diff(shift)) > lost)))
    first = np.flatnonzero(new)
    low, high = np.maximum(low[first], 0), np.maximum.reduceat(high, first)
    low0 = np.minimum.reduceat(start0, first) - (least - 1) - lost
    high0 = np.maximum.reduceat(end0, first) + (least - 1) + lost
    return np.cumsum(new) - 1, pair[first], low, high, np.maximum(low0, 0), high0


def similar_stretches(own: np.ndarray, bounds: np.ndarray, other: np.ndarray, bounds0: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of sequences of words, own[bounds[i]:bounds[i + 1]] and other alike: (pair, from, to).

    from:to are words of own, from a sequence's first, where it holds a passage similar
    to one of the other. Ends are cut back to words that both hold: those of the
    outermost shared shingles, and words beyond them, two in a row, that stand at the same
    place of the other passage, as they do where a word near an end is changed; one alone
    may be chance. What is then shorter than a passage goes.
    """
    lost = SHINGLE - 1
    sizes = np.maximum(np.diff(bounds) - lost, 0)
    sizes0 = np.maximum(np.diff(bounds0) - lost, 0)
    rolled, rolled0 = (_rolled(x) for x in (own, other))
    at, at0 = _flat(bounds[:-1], sizes), _flat(bounds0[:-1], sizes0)
    pair, pair0 = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes0)), sizes0)
    with np.errstate(over="ignore"):
        mine = rolled[at] + mix(pair.astype(np.uint64))
        theirs = np.unique(rolled0[at0] + mix(pair0.astype(np.uint64)))
    both = np.zeros(len(own) + 1, bool)
    if len(theirs):
        both[at] = theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine
    sums = np.concatenate(([0], np.cumsum(both)))
    starts = _flat(bounds[:-1], np.maximum(sizes - least + 1, 0))
    good = starts[sums[starts + least] - sums[starts] >= shared_at_least(least)]
    table = np.zeros((0, 3), np.int64)
    if len(good):
        owner = np.searchsorted(bounds, good, side="right") - 1
        first = np.flatnonzero(np.concatenate(([True], (np.diff(good) > least) | (np.diff(owner) != 0))))
        last = np.append(first[1:], len(good)) - 1
        held = np.flatnonzero(both)
        a = held[np.searchsorted(held, good[first])]
        b = held[np.searchsorted(held, good[last] + least) - 1] + SHINGLE
        for i in np.flatnonzero(b - a < least + lost).tolist():
            p, low, high = int(owner[first[i]]), int(good[first[i]]), int(good[last[i]])
            hashes0 = rolled0[bounds0[p] : max(bounds0[p + 1] - lost, bounds0[p])]

            def same(place: int, places: range) -> list[int]:
                """Words of ``places``, two in a row, that the other passage has at the same distance from the shingle at ``place``."""
                shift = int(np.flatnonzero(hashes0 == rolled[place])[0]) + int(bounds0[p]) - place
                found = {k for k in places if bounds0[p] <= k + shift < bounds0[p + 1] and k < bounds[p + 1] and own[k] == other[k + shift]}
                return [k for k in found if k - 1 in found or k + 1 in found]

            end = int(b[i])
            b[i] = max([end, *(k + 1 for k in same(end - SHINGLE, range(end, high + least + lost)))])
            a[i] = min([int(a[i]), *same(int(a[i]), range(low, int(a[i])))])
        accepted = b - a >= least + lost
        p = owner[first][accepted]
        table = np.stack([p, a[accepted] - bounds[p], b[accepted] - bounds[p]], axis=1)
    return table[:, 0], table[:, 1], table[:, 2]


def _rolled(words: np.ndarray) -> np.ndarray:
    """A hash of the SHINGLE words from each place on (of what follows, at the end)."""
    padded = np.concatenate((words.astype(np.uint64), np.zeros(SHINGLE - 1, np.uint64)))
    rolled = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            rolled = mix(rolled + padded[k : k + len(words)])
    return rolled


def _dealt_by_leader(links: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and texts by leader's document, with a salt: those of a document of very many go to several tasks, each with its text."""
    most = max(MANY, links.count() // 1000)
    large = links.groupBy("doc0").count().where(F.col("count") > most).select(F.col("doc0").alias("id"), F.ceil(F.col("count") / most).cast("int").alias("salts"))
    rows = links.withColumnRenamed("doc0", "id")
    sources = texts.withColumnRenamed("doc_id", "id")
    few = large.collect()  # under a thousand rows, by its threshold
    if not few:
        return rows.withColumn("salt", F.lit(0)), sources.withColumn("salt", F.lit(0))
    large = F.broadcast(links.sparkSession.createDataFrame(few, "id long, salts int"))
    salts = F.coalesce("salts", F.lit(1))
    rows = rows.join(large, "id", "left").withColumn("salt", F.pmod(F.xxhash64("doc"), salts).cast("int")).drop("salts")
    return rows, sources.join(large, "id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")


def _bytes(parts: list[np.ndarray] | np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value for each of ``parts``; or, of one array, for each of its pieces between ``cuts``."""
    data = np.ascontiguousarray(parts)
    bounds = (cuts * (data.itemsize * (data.size // max(len(data), 1)))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).cast(pa.binary())


def _parts(links: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(doc, doc0, windows, intervals, words) of each pair of documents: what the leader's document holds where windows of ``doc`` met it."""
    rows, sources = _dealt_by_leader(links, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, asks in _groups(batches, ("id", "kind", "doc")):
            if not asks.num_rows:
                continue
            doc0, doc, key, place, place0 = (asks.column(c).to_numpy() for c in ("id", "doc", "key", "place", "place0"))
            new = np.concatenate(([True], (np.diff(doc0) != 0) | (np.diff(doc) != 0)))
            first = np.flatnonzero(new)
            start, start0 = place >> _WIDE, place0 >> _WIDE
            end, end0 = start + (place & int(_PLACE)), start0 + (place0 & int(_PLACE))
            _, pair, low, high, low0, high0 = _intervals(np.cumsum(new) - 1, start, end, start0, end0, least)
            found = [words[d][a : b + SHINGLE - 1] for d, a, b in zip(doc0[first][pair].tolist(), low0.tolist(), high0.tolist(), strict=True)]
            sizes = np.array([len(x) for x in found], np.int64)
            cuts = np.searchsorted(pair, np.arange(len(first) + 1))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            yield _batch(
                {
                    "doc": doc[first],
                    "doc0": doc0[first],
                    "windows": _bytes(np.stack([key, place], axis=1), np.append(first, len(doc))),
                    "intervals": _bytes(np.stack([low, high, sizes], axis=1), cuts),
                    "words": _bytes(np.concatenate(found), ends[cuts]),
                }
            )

    dealt = _with_texts(sources, rows, "doc", "place", "key")
    return dealt.mapInArrow(run, "doc long, doc0 long, windows binary, intervals binary, words binary")


def _verified(parts: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """Passages (doc_id, start, end, source) that are similar to the leader's; with a key, windows (doc_id, place in start).

    These are windows that no passage covers (end 1, else 0), and all of pairs of documents without a passage (with the leader's as source).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, asks in _groups(batches, ("id", "kind")):
            if not asks.num_rows:
                continue
            doc, doc0 = asks.column("id").to_numpy(), asks.column("doc0").to_numpy()
            intervals = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in asks.column("intervals").to_pylist()]
            windows = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in asks.column("windows").to_pylist()]
            other = np.concatenate([np.frombuffer(x, np.uint32) for x in asks.column("words").to_pylist()])
            pair = np.repeat(np.arange(len(doc)), [len(x) for x in intervals])
            low, high, sizes0 = np.concatenate(intervals).T
            mine = [words[d][a : b + SHINGLE - 1] for d, a, b in zip(doc[pair].tolist(), low.tolist(), high.tolist(), strict=True)]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in mine])))
            at, start, end = similar_stretches(np.concatenate(mine), bounds, other, np.concatenate(([0], np.cumsum(sizes0))), least)
            start, end = start + low[at], end + low[at]
            spans = {"doc_id": doc[pair[at]], "start": start, "end": end, "source": doc0[pair[at]], "key": pa.nulls(len(at), pa.int64())}
            yield _batch(spans)
            # Windows outside all passages of their document, and those of pairs without any.
            sizes = [len(x) for x in windows]
            owner, source = np.repeat(doc, sizes), np.repeat(doc0, sizes)
            alone = np.repeat(~np.isin(np.arange(len(doc)), pair[at]), sizes)
            key, place = np.concatenate(windows).T
            number = {d: i for i, d in enumerate(dict.fromkeys(doc.tolist()))}
            wide = np.int64(1) << 40
            group = np.array([number[d] for d in owner.tolist()], np.int64)
            span = np.array([number[d] for d in spans["doc_id"].tolist()], np.int64)
            order = np.argsort(span * wide + start, kind="stable")
            reach = np.maximum.accumulate((span * wide + end)[order])
            a, b = place >> _WIDE, (place >> _WIDE) + (place & int(_PLACE)) + SHINGLE - 1
            before = np.searchsorted((span * wide + start)[order], group * wide + a, side="right") - 1
            covered = (before >= 0) & (reach[np.maximum(before, 0)] >= group * wide + b) if len(reach) else np.zeros(len(key), bool)
            keep = ~covered | alone
            yield _batch({"doc_id": owner[keep], "start": place[keep], "end": (~covered[keep]).astype(np.int64), "source": pa.array(source[keep], mask=~alone[keep]), "key": key[keep]})

    dealt = _with_texts(texts, parts.withColumnRenamed("doc", "id"), "doc0")
    return dealt.mapInArrow(run, "doc_id long, start long, end long, source long, key long")


def _contexts(open_windows: DataFrame, keys: DataFrame, classes: DataFrame, links: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(key, doc, place, open, class, at, words) of all windows of ``keys``: their document's class, and the words around, from word ``at`` on."""
    rows = links.join(keys, "key", "left_semi")
    leaders = rows.where("doc0 is not null").select("key", F.col("doc0").alias("doc"), F.col("place0").alias("place")).distinct()
    windows = rows.select("key", "doc", "place", F.lit(0).alias("open")).unionByName(leaders.withColumn("open", F.lit(0)))
    windows = windows.unionByName(open_windows.withColumn("open", F.lit(1))).groupBy("key", "doc", "place").agg(F.max("open").alias("open"))
    windows = _with_class(windows, classes, "doc", "class")
    around = 2 * least - shared_at_least(least) - 1  # shingles beside a window: what a stretch, or one similar to it, can reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, asks in _groups(batches, ("id",)):
            for part in asks.to_batches(max_chunksize=8192):
                doc, place = part.column("id").to_numpy(), part.column("place").to_numpy()
                start = np.maximum((place >> _WIDE) - around, 0)
                end = (place >> _WIDE) + (place & int(_PLACE)) + around + SHINGLE - 1
                found = [words[d][a:b] for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)]
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                yield _batch({"key": part.column("key"), "doc": doc, "place": place, "open": part.column("open"), "class": part.column("class"), "at": start, "words": _bytes(np.concatenate(found), cuts)})

    windows = written(windows, "open")
    asked = texts.join(windows.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    dealt = _with_texts(asked, windows.withColumnRenamed("doc", "id"), "place", "key")
    return dealt.mapInArrow(run, "key long, doc long, place long, open int, class long, at long, words binary")


def _with_class(rows: DataFrame, classes: DataFrame, doc: str, name: str) -> DataFrame:
    """``rows`` with the class of a document: the smallest one that passages link it with."""
    known = classes.select(F.col("node").alias(doc), F.col("component").alias(name))
    return rows.join(known, doc, "left").withColumn(name, F.coalesce(name, doc))


def _met(doc: np.ndarray, at: np.ndarray, is_open: np.ndarray, group: np.ndarray, words: list[np.ndarray], least: int) -> list[tuple[int, int, int, int]]:
    """Passages (doc, start, end, source) of one key's windows, in order of documents: of the open ones, and such that link two classes.

    Of any two classes one is not the largest, so its windows ask.
    """
    enough = shared_at_least(least)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in words])))
    flat = np.concatenate(words)
    sizes = np.maximum(np.diff(bounds) - SHINGLE + 1, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, kind = np.unique(_rolled(flat)[_flat(bounds[:-1], sizes)], return_inverse=True)
    # Shingles that two documents have at least: what several rows share without them does not count.
    low, high = np.full(kind.max() + 1 if len(kind) else 0, np.iinfo(np.int64).max), np.full(kind.max() + 1 if len(kind) else 0, np.iinfo(np.int64).min)
    np.minimum.at(low, kind, doc[row])
    np.maximum.at(high, kind, doc[row])
    shared = (low < high)[kind]
    sums = np.concatenate(([0], np.cumsum(shared)))
    first = np.concatenate(([0], np.cumsum(sizes)))
    starts = _flat(first[:-1], np.maximum(sizes - least + 1, 0))
    may = np.zeros(len(sizes), bool)
    may[row[starts[sums[starts + least] - sums[starts] >= enough]]] = True
    names, group, sizes_of = np.unique(group, return_inverse=True, return_counts=True)
    asking = np.flatnonzero(may & (is_open | (group != sizes_of.argmax())))
    if not len(asking):
        return []
    listed = np.flatnonzero(shared & may[row])
    pairs = np.unique(kind[listed] * np.int64(len(sizes)) + row[listed])
    holders, of = pairs % len(sizes), pairs // len(sizes)
    cuts = np.searchsorted(of, np.arange(len(low) + 1))
    out: list[tuple[int, int, int, int]] = []
    held = np.zeros(len(low), bool)
    for x in asking.tolist():
        own = kind[first[x] : first[x + 1]]
        mine, times = np.unique(own, return_counts=True)
        many = cuts[mine + 1] - cuts[mine]
        both = np.bincount(holders[_flat(cuts[mine], many)], np.repeat(times, many), len(sizes))
        done = not is_open[x]
        met = np.flatnonzero((both >= enough) & (doc != doc[x]) & ((group != group[x]) | (not done and doc < doc[x])))
        for y in met[np.lexsort((-both[met], doc[met] > doc[x]))].tolist():
            if group[x] == group[y] and (done or doc[y] > doc[x]):
                continue
            other = kind[first[y] : first[y + 1]]
            held[other] = True
            sums = np.concatenate(([0], np.cumsum(held[own])))
            held[other] = False
            if (sums[least:] - sums[:-least]).max() < enough:
                continue
            later, source = (x, y) if doc[y] < doc[x] else (y, x)
            _, start, end = similar_stretches(words[later], np.array([0, len(words[later])]), words[source], np.array([0, len(words[source])]), least)
            if len(start):
                out += [(int(doc[later]), int(at[later]) + a, int(at[later]) + b, int(doc[source])) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                done |= later == x
                group[group == group[y]] = group[x]
    return out


def _further(rows: DataFrame, least: int) -> DataFrame:
    """Passages that windows of one key hold beside those of its leader: see :func:`_met`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, seen = None, [], set()

        def found() -> list[tuple[int, int, int, int]]:
            if not any(h[2] for h in held) and len({h[3] for h in held}) < 2:
                return []
            doc, at, is_open, group = (np.array([h[k] for h in held], kind) for k, kind in enumerate((np.int64, np.int64, bool, np.int64)))
            return _met(doc, at, is_open, group, [np.frombuffer(h[4], np.uint32) for h in held], least)

        def out(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            table = np.array(rows, np.int64).reshape(-1, 4)
            return _batch({n: table[:, i] for i, n in enumerate(("doc_id", "start", "end", "source"))})

        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "at", "open", "class", "words")), strict=True):
                if key != now:
                    rows += found()
                    now, held, seen = key, [], set()
                # Of a class' windows with equal words around that passages cover, the first stands for all.
                if row[2] or (row[3], row[4]) not in seen:
                    held.append(row)
                    if not row[2]:
                        seen.add((row[3], row[4]))
            yield out(rows)
        yield out(found())
        give_back()

    dealt = rows.repartition("key").sortWithinPartitions("key", "doc", "place")
    return dealt.mapInArrow(run, "doc_id long, start long, end long, source long")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, end, source): words start to end of a document repeat a passage of ``source``, which has a smaller doc_id."""
    return _passages(_one_text_each(docs)[0], least_words)


def _passages(texts: DataFrame, least_words: int) -> DataFrame:
    least = least_words - SHINGLE + 1
    links = _links(texts, least)
    copies = links.where("place < 0 and place = place0")
    whole = copies.select(F.col("doc").alias("doc_id"), F.lit(0).cast("long").alias("start"), ((-1 - F.col("place")) / (1 << 20) + SHINGLE - 1).cast("long").alias("end"), F.col("doc0").alias("source"))
    # What a copy holds, its first document holds.
    links = written(links.where("place >= 0").join(copies.select("doc"), "doc", "left_anti").select(*links.columns), "links")
    met = written(_verified(_parts(links.where("doc0 is not null"), texts, least), texts, least), "verified")
    rest, found = met.where("key is not null"), met.where("key is null").select(*whole.columns)
    classes = written(components(found.select(F.col("doc_id").alias("a"), F.col("source").alias("b")).distinct()), "classes")
    open_windows = rest.where("end = 1").select("key", F.col("doc_id").alias("doc"), F.col("start").alias("place"))
    # Keys whose leader's class does not hold all of their documents.
    apart = _with_class(_with_class(rest.where("source is not null"), classes, "doc_id", "own"), classes, "source", "other").where("own <> other")
    keys = open_windows.select("key").unionByName(apart.select("key")).distinct()
    more = _further(_contexts(open_windows, keys, classes, links, texts, least), least)
    return whole.unionByName(found).unionByName(more)


def spans_of(passages: DataFrame) -> DataFrame:
    """doc_id, spans (joined, in order, array of (start, end)) and sources of each document with repeated passages."""
    joined = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return passages.groupBy("doc_id").agg(joined.alias("spans"), F.array_sort(F.collect_set("source")).alias("sources"))


def passage_report(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row a document: the class of documents that passages link, the words to cut and where they stand first.

    component_id is the smallest doc_id reachable by shared passages (its own without
    any), spans are "from:to" in words, to exclusive, joined by commas.
    """
    passages = written(repeated_passages(docs, least_words), "passages")
    linked = components(passages.select(F.col("doc_id").alias("a"), F.col("source").alias("b")).distinct())
    spans = spans_of(passages).withColumnRenamed("doc_id", "own")
    said = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(linked, F.col("doc_id") == F.col("node"), "left").join(spans, F.col("doc_id") == F.col("own"), "left")
    return out.select(
        "doc_id",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"),
        F.coalesce(words, F.lit(0).cast("long")).alias("repeated_words"),
        F.coalesce(said, F.lit("")).alias("spans"),
        F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"),
    )


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans, each gone up to the next word that stays."""
    places = [m.start() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        if start < len(places):
            out.append(text[at : places[start]])
            at = places[end] if end < len(places) else len(text)
    return "".join(out) + text[at:]


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The same columns, repeated passages cut from all documents but that where they stand first; n_chars, if there, follows.

    A document of which nothing is left goes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)
    texts, again = _one_text_each(docs)
    spans = written(spans_of(_passages(texts, least_words)).select(F.col("doc_id").alias("__own"), F.col("spans").alias("__spans")), "spans")
    rows = docs.join(spans, F.col("doc_id") == F.col("__own"), "left").drop("__own")
    if again is not None:
        # The spans are those of one text; a row of that id with another text stays as it is.
        signs = again.select(F.col("doc_id").alias("__own"), F.col("sign").alias("__sign"))
        own = F.col("__sign").isNull() | (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("__sign"))
        rows = rows.join(signs, F.col("doc_id") == F.col("__own"), "left").withColumn("__spans", F.when(own, F.col("__spans"))).drop("__own", "__sign")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at = [i for i, v in enumerate(batch.column("__spans").is_valid().to_pylist()) if v]
            columns = {n: batch.column(n) for n in schema.names}
            if at:
                texts, lists = columns["text"].to_pylist(), batch.column("__spans")
                keep = np.ones(len(texts), bool)
                for i in at:
                    if texts[i] is not None:
                        texts[i] = cut_text(texts[i], [(x["start"], x["end"]) for x in lists[i].as_py()])
                        keep[i] = bool(texts[i].strip())
                columns["text"] = pa.array(texts, schema.field("text").type)
                if "n_chars" in columns:
                    sizes = columns["n_chars"].to_pylist()
                    for i in at:
                        sizes[i] = len(texts[i]) if texts[i] is not None else sizes[i]
                    columns["n_chars"] = pa.array(sizes, schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema=schema).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema=schema)

    return rows.mapInArrow(run, docs.schema)
