"""Periodic runs: stretches of words that repeat with a period, found in whole texts and collapsed.

A run is a stretch of at least ``max(6, 4 * q)`` consecutive words whose smallest
period is q and that no neighbouring word extends keeping that period. A lag q can
have one only if at least ``max(6 - q, 3 * q)`` words equal the word q places on, so
those matches are counted for every lag first: of words that are frequent in the
text by exact autocorrelation (a Fourier transform of their places, rounded to whole
numbers), of all others by the differences of pairs of places. Only lags with enough
matches are scanned for islands, stretches of consecutive matches: an island holds a
block that starts at a multiple of the lag, so blocks there are compared by prefix
hashes, those that agree are read word by word, and those within a run of a divisor
of the lag are that run.

Words are compared exactly (as codes of a dictionary), case counts. Memory follows
the largest text or 8 MB of texts; no row meets another, so nothing is shuffled.

Cases: a null or blank text has no runs and collapses to an empty text; a null doc_id
stays null; repeated rows are reported each; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import id_text, slices
from .words import mix, split

LEAST, TIMES = 6, 4  # a run has so many words, and so many periods, at least
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_PAIRS = 1 << 21  # lags gathered before they are counted


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed): the runs by start, then period, and the text's words without a run's repeats.

    A word goes if any run contains it after that run's first ``period`` words; the words
    kept are joined by one space.
    """
    return id_text(docs).mapInArrow(_found, SCHEMA)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        offsets, values = split(batch.column("text"), lower=False)
        codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        runs, kept = runs_of(offsets, codes), np.ones(len(codes), bool)
        for at, found in zip(offsets[:-1], runs):
            for start, length, period in found:
                kept[at + start + period : at + start + length] = False
        ends = np.concatenate(([0], np.cumsum(kept)))[offsets]
        words = values if kept.all() else values.filter(pa.array(kept))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), " ")
        rows = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind), joined], ["doc_id", "runs", "collapsed"])


def runs_of(offsets: np.ndarray, codes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, whose words are ``codes[offsets[i]:offsets[i + 1]]``."""
    counts, bases = lag_counts(offsets, codes)
    lags = np.arange(len(counts)) - np.repeat(bases[:-1], np.diff(bases))
    enough = np.flatnonzero((lags > 0) & (counts >= np.maximum(LEAST - lags, (TIMES - 1) * lags)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in offsets[1:]]
    texts = np.searchsorted(bases, enough, side="right") - 1
    for text in np.unique(texts):
        some = lags[enough[texts == text]] if len(texts) < 1000 else lags[enough[np.searchsorted(texts, text) : np.searchsorted(texts, text, side="right")]]
        out[text] = _scanned(codes[offsets[text] : offsets[text + 1]], some)
    return out


def lag_counts(offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, bases): ``counts[bases[i] + q]`` words of text i equal the word q places on, for q up to a quarter of its words."""
    sizes = np.diff(offsets)
    most = sizes // TIMES
    bases = np.concatenate(([0], np.cumsum(most + 1)))
    counts = np.zeros(bases[-1], np.int64)
    if not len(codes):
        return counts, bases
    text = np.repeat(np.arange(len(sizes)), sizes)
    key = text * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    uses = np.diff(np.append(starts, len(order)))
    owner = text[order[starts]]
    heavy = uses > _heavy(sizes)[owner]
    _count_pairs(counts, order, np.repeat(np.where(heavy, -1, np.arange(len(uses))), uses), most[text[order]], bases[text[order]])
    for i in np.unique(owner[heavy]):
        words = [order[starts[g] : starts[g] + uses[g]] - offsets[i] for g in np.flatnonzero(heavy & (owner == i))]
        counts[bases[i] + 1 : bases[i + 1]] += _autocorrelation(words, int(sizes[i]), int(most[i]))
    return counts, bases


def _heavy(sizes: np.ndarray) -> np.ndarray:
    """Uses of a word from which a transform of the text is cheaper than its pairs."""
    return np.maximum(64, np.sqrt(sizes * np.log2(np.maximum(sizes, 2))))


def _count_pairs(counts: np.ndarray, places: np.ndarray, group: np.ndarray, most: np.ndarray, base: np.ndarray) -> None:
    """Add the differences, up to ``most``, of places of one group; ``places`` rise within a group, group -1 does not count."""
    at, step, waiting, held = np.flatnonzero((group >= 0) & (most > 0)), 0, [], 0
    while len(at):
        step += 1
        at = at[at + step < len(places)]
        at = at[group[at + step] == group[at]]
        lag = places[at + step] - places[at]
        near = lag <= most[at]  # later places of the group are farther
        at, lag = at[near], lag[near]
        waiting.append(base[at] + lag)
        held += len(at)
        if held > _PAIRS or not len(at):
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
            waiting, held = [], 0


def _autocorrelation(words: list[np.ndarray], size: int, most: int) -> np.ndarray:
    """Pairs of places of one word at each lag from 1 to ``most``, over all words."""
    width = 1 << (size + most).bit_length()
    power = np.zeros(width // 2 + 1)
    for places in words:
        here = np.zeros(width)
        here[places] = 1.0
        f = np.fft.rfft(here)
        power += f.real**2 + f.imag**2
    return np.rint(np.fft.irfft(power, width)[1 : most + 1]).astype(np.int64)


def _scanned(codes: np.ndarray, lags: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of one text whose periods are among ``lags`` (rising)."""
    n = len(codes)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, 0x9E3779B97F4A7C15, np.uint64))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(codes) * powers[:n], dtype=np.uint64)))
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    for q in (int(x) for x in lags):
        least = max(LEAST - q, (TIMES - 1) * q)
        block = least - q + 1  # of any `least` matches in a row, so many begin at a multiple of q
        x = np.arange(0, n - q - block + 1, q)
        with np.errstate(over="ignore"):
            x = x[(sums[x + block] - sums[x]) * powers[q] == sums[x + q + block] - sums[x + q]]
        for period, (begins, ends) in known.items():
            if not len(x):
                break
            if q % period == 0:
                last = np.searchsorted(begins, x, side="right") - 1
                x = x[(last < 0) | (ends[last] < x + q + block)]
        found, after = [], -1
        for at in x.tolist():
            if at < after:
                continue
            stop = _forward(codes, q, at)
            start = _backward(codes, q, at)
            after = max(stop, at + 1)
            if stop - start >= least:
                found.append((start, stop + q))
        if found:
            known[q] = tuple(np.array(x) for x in zip(*found))
            out += [(start, end - start, q) for start, end in found]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _forward(codes: np.ndarray, q: int, at: int) -> int:
    """The first place from ``at`` on whose word differs from the word q places on."""
    width, end = 64, len(codes) - q
    while at < end:
        to = min(at + width, end)
        differ = codes[at:to] != codes[at + q : to + q]
        if differ.any():
            return at + int(differ.argmax())
        at, width = to, 2 * width
    return end


def _backward(codes: np.ndarray, q: int, at: int) -> int:
    """The first place of the matches in a row that end before ``at``."""
    width = 64
    while at > 0:
        since = max(at - width, 0)
        differ = (codes[since:at] != codes[since + q : at + q])[::-1]
        if differ.any():
            return at - int(differ.argmax())
        at, width = since, 2 * width
    return 0


WORDS = r"[\x20\x09-\x0D]+"


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where documents whose id's crc32 is a multiple of ten repeat a part of their words to the end.

    From word a = g % n on, with g a tenth of the crc32, word i becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    A document without an id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = id_text(docs).withColumns({"h": h, "g": F.floor(h / F.lit(10)).cast("long")})
    words = F.filter(F.split("text", WORDS), lambda w: w != "")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.col("g") % n
        p = F.floor((n - a) / (F.lit(3) + F.col("g") % 8)) + 1
        from_a = lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w)
        return F.when(n > 0, F.array_join(F.transform(words, from_a), " ")).otherwise("")

    text = F.when(F.col("h") % 10 == 0, F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Digests of the runs of :func:`planted` documents, and the run of the greatest exponent (ties: smallest start, then period)."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return find_runs(planted(docs)).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
