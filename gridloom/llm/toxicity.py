"""Toxicity scores from a learned lexicon, misspellings included.

Word counts of all labelled training texts (toxic and clean documents that hold
a word) give a lexicon of words and word beginnings that toxic texts use far
more. The lexicon is a trie; intersected with Levenshtein automata of distance
one it becomes one automaton, built as words are read, that finds exact terms,
beginnings and misspelled terms. Each (term, distance) has its own weight, from
the same counts, so that a spelling close to a term weighs only what it proved
to. A hit that stands in quotation marks, or near a word of reporting, weighs
half. The score is that of two Poisson rates: each hit adds the logarithm of its
term's rates in toxic and clean texts, each word takes off a share of the rate of
hits that a toxic text would have.

A null or empty text has no hits and gets the score of a text without any; a
repeated row gets the same score again. Without usable labels the score is 0.5.
Labels count once a document (toxic if any of its labels is); null labels and
labels of unknown documents do not count. Words of all labelled training texts count
(of MOST_LABELLED documents, if more are labelled);
as evidence, texts that share their least shingle hash, as copies do, are one family
and count once a label, for copies of one text prove nothing about its words. Columns other than doc_id and text do
not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_text, remove, slices, written
from .words import mix, shingles, split, word_hashes

THRESHOLD = 0.7
SLICE = 1 << 20  # bytes of text at a time
MOST_LABELLED = 4_000_000  # training documents that are learned from, drawn by id where there are more labels
LEAST_EVIDENCE = 30.0  # G-squared of a term
LEAST_RATIO = 6  # of a term's rates in toxic and clean texts
DAMPED = 0.3  # of the expected rate of hits
STEMS = (4, 5, 6, 7, 8)  # letters of word beginnings
ID_BITS = 1 << 24
COUNTS = ("toxic", "clean", "toxic_words", "clean_words")
FUZZY = 5  # letters that a term needs to be matched with an error
LEAST_WEIGHT = 1.5  # of a term matched with an error
WINDOW = 8  # words on either side
QUOTED = 0.5
# What is taken off a word's ends, opening and closing marks, words of reporting.
ENDS = ".,;:!?()[]{}<>*_-~#|/\\'\"`«»„“”‘’…"
OPEN, CLOSE = "\"'«„“‘", "\"'»“”’"
REPORTING = frozenset("said says wrote called quote quoted quoting dijo escribió cita dit écrit citation sagte schrieb zitat".split())


@dataclass
class Lexicon:
    """Terms with their weights; ``base`` is the score's value without any hit."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    near: dict[str, float] = field(default_factory=dict)  # weight of a term matched with one error
    base: float = 0.0
    rate: float = 0.0  # what each word of a text, hit or not, takes off


class Matcher:
    """The lexicon's trie intersected with Levenshtein automata, made deterministic step by step.

    A state is a set of (trie node, errors so far). States and steps are kept until the states
    hold ``most`` nodes, then all are forgotten together.
    """

    def __init__(self, lexicon: Lexicon, most: int = 500_000):
        self.child: list[dict[str, int]] = [{}]
        self.word: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        self.fuzzy: set[int] = set()
        for terms, ends in ((lexicon.words, self.word), (lexicon.stems, self.stem)):
            for term in sorted(terms):
                node = 0
                for c in term:
                    if c not in self.child[node]:
                        self.child.append({})
                        self.child[node][c] = len(self.child) - 1
                    node = self.child[node][c]
                ends[node] = term
        self._mark(lexicon)
        self.most = most
        self.start = self._closed({(0, 0)})
        self._forget()

    def _forget(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.states: list[frozenset] = [self.start]
        self.number: dict[frozenset, int] = {self.start: 0}
        self.ends: list[tuple[str, int] | None] = [None]
        self.stems_at: list[str | None] = [None]
        self.held = len(self.start)

    def _mark(self, lexicon: Lexicon) -> None:
        """Nodes on the way to a word long enough to be matched with an error."""
        for term in lexicon.words:
            if len(term) >= FUZZY:
                node = 0
                self.fuzzy.add(0)
                for c in term:
                    node = self.child[node][c]
                    self.fuzzy.add(node)

    def _closed(self, state: set) -> frozenset:
        more = {(n, 1) for node, e in state if e == 0 for n in self.child[node].values() if n in self.fuzzy}
        return frozenset(state | {x for x in more if (x[0], 0) not in state})

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in state:
            if (n := self.child[node].get(c)) is not None and (e == 0 or n in self.fuzzy):
                out.add((n, e))
            if e == 0:
                if node in self.fuzzy:
                    out.add((node, 1))
                out |= {(n, 1) for d, n in self.child[node].items() if d != c and n in self.fuzzy}
        return self._closed({x for x in out if x[1] == 0 or (x[0], 0) not in out})

    def _number(self, state: frozenset) -> int:
        if (k := self.number.get(state)) is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
            self.held += len(state) + 1
            hits = sorted((e, self.word[n]) for n, e in state if n in self.word and (e == 0 or len(self.word[n]) >= FUZZY))
            self.ends.append((hits[0][1], hits[0][0]) if hits else None)
            self.stems_at.append(max((self.stem[n] for n, e in state if e == 0 and n in self.stem), default=None))
        return k

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, 0) for the word itself, (beginning + '-', 0) for a beginning, (term, 1) for one error, or None."""
        if self.held + len(self.steps) > self.most:  # between words, when no state is in use
            self._forget()
        now, stem, steps = 0, None, self.steps
        for c in word:
            new = steps.get((now, c))
            if new is None:
                new = steps[now, c] = self._number(self._step(self.states[now], c))
            now = new
            stem = self.stems_at[now] or stem
            if not self.states[now]:
                break
        end = self.ends[now]
        if end is not None and end[1] == 0 or stem is None:
            return end
        return f"{stem}-", 0


def plain(word: str) -> str:
    return word.lower().strip(ENDS)


def held_out(doc_id):
    """The column that says whether a document's labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def id_bits(ids: DataFrame, bits: int = ID_BITS) -> np.ndarray:
    """A bitmap of fixed size with the hash of each doc_id set; what is not set is not among ``ids``."""
    pieces = 16

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[_bit(batch.column("doc_id").to_numpy(), bits)] = True
        packed = np.packbits(own).reshape(pieces, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], names=["piece", "bits"])

    def either(key, table):
        out = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    rows = ids.select("doc_id").mapInArrow(mark, "piece int, bits binary").groupBy("piece").applyInArrow(either, "piece int, bits binary").collect()
    if not rows:
        return np.zeros(bits // 8, np.uint8)
    return np.frombuffer(b"".join(r["bits"] for r in sorted(rows, key=lambda r: r["piece"])), np.uint8)


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _least_shingles(texts: pa.Array) -> np.ndarray:
    """The least shingle hash of each text as a signed number; 0 without words."""
    offsets, hashes = shingles(*word_hashes(texts))
    out = np.zeros(len(texts), np.uint64)
    some = np.diff(offsets) > 0
    if some.any():
        out[some] = np.minimum.reduceat(hashes, offsets[:-1][some])
    return out.view(np.int64)


def word_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """term and COUNTS: families of training documents of either label that hold a term, and its occurrences in all of them.

    The null term counts all families and words.
    A term is a digit and a word (0) or the beginning of longer words (its letters).
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    n = known.count()
    if n > MOST_LABELLED:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * MOST_LABELLED // n)
    labelled = id_bits(known)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            at = _bit(batch.column("doc_id").to_numpy(), 8 * len(labelled))
            batch = batch.filter(pa.array(labelled[at >> 3] >> (7 - (at & 7)) & 1 == 1))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_least_shingles(batch.column("text"))), batch.column("doc_id"), batch.column("text")], names=["sign", "doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the last family, which the next slice may go on with: its sign, and the terms that each label has counted.
        last, counted = None, (set(), set())
        for batch in slices(batches, "text", SLICE):
            sign, toxic = batch.column("sign").to_numpy(), batch.column("toxic").to_numpy().astype(bool)
            new = np.concatenate(([sign[0] != last], np.diff(sign) != 0))
            # Family and label of each text; number 0 and 1 are the family from before.
            family = 2 * np.cumsum(new) + toxic
            if last is None:
                counted = (set(), set())
            offsets, values = split(batch.column("text"))
            found = values.dictionary_encode()
            words = [plain(w) for w in found.dictionary.to_pylist()]
            index = found.indices.to_numpy()
            doc = np.repeat(np.arange(len(toxic)), np.diff(offsets))
            bad = toxic[doc]
            own = family[doc]
            final = 2 * int(np.cumsum(new)[-1])
            known_terms: tuple[set, set] = (set(), set())
            first = np.setdiff1d(family, [y for y in (0, 1) if None in counted[y]])
            terms: list[str | None] = [None]
            counts = [np.array([[np.count_nonzero(first % 2), np.count_nonzero(first % 2 == 0), bad.sum(), (~bad).sum()]])]
            for k in (0, *STEMS):
                number: dict[str, int] = {}
                heads = words if not k else [w[:k] if len(w) > k else "" for w in words]
                same = np.array([number.setdefault(w, len(number)) for w in heads] or [0], np.int64)
                wide = max(len(number), 1)
                every = same[index] if len(index) else np.zeros(0, np.int64)
                pairs = np.unique(own * wide + every)
                of, term = pairs // wide, pairs % wide
                names = [f"{k}{w}" for w in number]
                old = np.zeros(len(pairs), bool)
                for i in np.flatnonzero(of < 2).tolist():
                    old[i] = names[term[i]] in counted[of[i]]
                for i in np.flatnonzero(of >= final).tolist():
                    known_terms[of[i] - final].add(names[term[i]])
                terms += names
                of, term = of[~old], term[~old]
                each = (term[of % 2 == 1], term[of % 2 == 0], every[bad], every[~bad])
                counts.append(np.stack([np.bincount(x, minlength=len(number)) for x in each], axis=1).reshape(-1, 4))
            for y in (0, 1):
                if (family == final + y).any():
                    known_terms[y].add(None)
            counted = tuple(a | b for a, b in zip(counted, known_terms, strict=True)) if final == 0 else known_terms
            last = sign[-1]
            table = np.concatenate(counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array(table[:, i]) for i in range(4))], names=["term", *COUNTS])

    # The bitmap spares most unlabelled texts the way to the join, which then decides.
    texts = id_text(docs).mapInArrow(signed, "sign long, doc_id long, text string")
    texts = texts.join(known.hint("merge"), "doc_id").select("sign", "text", "toxic")
    texts = texts.repartition("sign").sortWithinPartitions("sign")
    counted = texts.mapInArrow(run, "term string, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _evidence(yes, no, all_yes: int, all_no: int):
    """G-squared of a term that toxic documents hold more often than clean ones, else 0."""
    share = all_yes / (all_yes + all_no)
    expected_yes, expected_no = (yes + no) * share, (yes + no) * (1 - share)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return F.when(yes > expected_yes, 2 * (part(yes, expected_yes) + part(no, expected_no))).otherwise(0.0)


def _strong(counts: np.ndarray, total, words_yes: int, words_no: int) -> bool:
    """Whether COUNTS of a beginning are evidence enough."""
    yes, no, toxic_words, clean_words = counts.tolist()
    share = total["toxic"] / (total["toxic"] + total["clean"])
    expected = (yes + no) * share
    if yes <= expected or toxic_words / words_yes < LEAST_RATIO * clean_words / words_no:
        return False
    g = 2 * (yes * math.log(yes / expected) + (no * math.log(no / (yes + no - expected)) if no else 0.0))
    return 0.95 * g >= LEAST_EVIDENCE


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon of the training documents: every term with evidence enough that no chosen beginning covers.

    A term needs several toxic documents, so MOST_LABELLED bounds the lexicon, which goes to every task.
    """
    counts = written(word_counts(docs, labels), "toxic-words")
    total = counts.where("term is null").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return Lexicon()
    words_yes, words_no = total["toxic_words"] + 1, total["clean_words"] + 1

    def weight(yes: float, no: float, prior: float = 0.5) -> float:
        return math.log((yes + prior) / words_yes) - math.log((no + prior) / words_no)

    parts = counts.where("length(term) > 1").withColumns({"kind": F.expr("left(term, 1)"), "word": F.expr("substring(term, 2)")})
    g = _evidence(F.col("toxic"), F.col("clean"), total["toxic"], total["clean"])
    # A word itself goes before a beginning that says hardly more.
    strong = parts.withColumn("g", g * F.when(F.col("kind") == "0", 1.0).otherwise(0.95)).where(F.col("g") >= LEAST_EVIDENCE)
    strong = strong.where(F.col("toxic_words") / words_yes >= LEAST_RATIO * F.col("clean_words") / words_no)
    out = Lexicon(base=math.log(total["toxic"] / total["clean"]))
    rate = 0.0
    # Occurrences and documents of chosen terms, by the beginnings that cover them.
    taken: dict[str, np.ndarray] = {}
    for r in strong.orderBy(F.desc("g"), "kind", "word").toLocalIterator():
        term = r["word"]
        heads = [term[:k] for k in STEMS if k < len(term)]
        if any(h in out.stems for h in heads):
            continue
        own = np.array([r[c] for c in COUNTS])
        if r["kind"] != "0":
            # A beginning stands for what no longer term has said.
            own = np.maximum(own - taken.get(term, 0), 0)
            if not _strong(own, total, words_yes, words_no):
                continue
        for h in heads:
            taken[h] = taken.get(h, 0) + own
        toxic_words, clean_words = own[2:].tolist()
        (out.words if r["kind"] == "0" else out.stems)[term] = weight(toxic_words, clean_words)
        rate += max(0.0, toxic_words / words_yes - clean_words / words_no)
    out.rate = DAMPED * rate

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, sums = Matcher(out), {}
        for batch in batches:
            for w, y, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hit = matcher.match(w)
                if hit is not None and hit[1]:
                    have = sums.get(hit[0], (0, 0))
                    sums[hit[0]] = have[0] + y, have[1] + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([y for y, _ in sums.values()], pa.int64()), pa.array([n for _, n in sums.values()], pa.int64())],
            names=["term", "yes", "no"],
        )

    words = parts.where("kind = '0'").select("word", "toxic_words", "clean_words")
    spelled = words.mapInArrow(near, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    seen = {r["term"]: (r["yes"], r["no"]) for r in spelled.collect()}  # one row a term of the lexicon
    for w, own in out.words.items():
        if len(w) >= FUZZY:
            # Unseen, a misspelling weighs half its term; what is seen soon outweighs that.
            y, n = seen.get(w, (0, 0))
            half = math.exp(own / 2) * words_yes / words_no
            value = weight(y + half / (1 + half), n + 1 / (1 + half), 1e-9)
            out.near[w] = value if value >= LEAST_WEIGHT else 0.0
    remove(docs.sparkSession, counts)
    return out


class Scorer:
    """Scores of Arrow batches of texts under a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.matcher = lexicon, Matcher(lexicon)

    def _hit(self, word: str) -> tuple[str, int] | None:
        hit = self.matcher.match(plain(word))
        return None if hit is None or self.weight(hit) == 0 else hit

    def weight(self, hit: tuple[str, int]) -> float:
        term, errors = hit
        return self.lexicon.near.get(term, 0.0) if errors else self.lexicon.stems[term[:-1]] if term.endswith("-") and term[:-1] in self.lexicon.stems else self.lexicon.words[term]

    def score(self, texts: pa.Array) -> np.ndarray:
        offsets, values = split(texts)
        found = values.dictionary_encode()
        words = found.dictionary.to_pylist()
        hits = [self._hit(w) for w in words]
        flags = np.array([h is not None for h in hits] or [False])
        index = found.indices.to_numpy()
        at = np.flatnonzero(flags[index]) if len(index) else np.zeros(0, np.int64)
        doc = np.searchsorted(offsets, at, side="right") - 1
        sums: dict[int, dict] = {}
        for i, d in zip(at.tolist(), doc.tolist(), strict=True):
            low, high = max(offsets[d], i - WINDOW), min(offsets[d + 1], i + WINDOW + 1)
            hit = hits[index[i]]
            value = self.weight(hit)
            if self._quoted([words[k] for k in index[low:high]], i - int(low)):
                value *= QUOTED
            sums.setdefault(d, {}).setdefault(index[i], []).append(value)
        out = self.lexicon.base - self.lexicon.rate * np.diff(offsets)
        for d, own in sums.items():
            out[d] += sum(sum(values) for values in own.values())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    @staticmethod
    def _quoted(window: list[str], at: int) -> bool:
        """Whether the word at ``at`` stands between quotation marks, or has a word of reporting near."""
        begun = any(w[:1] in OPEN and w[:1] for w in window[: at + 1])
        ended = any(w.rstrip(".,;:!?")[-1:] in CLOSE and w.rstrip(".,;:!?")[-1:] for w in window[at:])
        return begun and ended or any(plain(w) in REPORTING for w in window)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in slices(batches, "text", SLICE):
            score = scorer.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    out = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, unchanged."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = to_arrow_schema(docs.schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in slices(batches, "text", SLICE):
            keep = scorer.score(batch.column("text")) < THRESHOLD
            yield batch.filter(pa.array(keep)).select(names)

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the training labels and scores every document."""
    return scored(docs, learn(docs, labels))
