"""Log-probabilities of texts under a log-bilinear neural model.

The model predicts the next item from the two before it: the context's vector is a
linear map of their vectors, an item's score its product with the item's vector, plus a
bias. Items are the most frequent words of the training texts, the end mark among them,
as many as ROOTS times the square root of the number of types, and bands of the other
words, those whose counts have the same power of two: both grow with the corpus, and
every word is in one. A word of a band has the band's probability times its share of the
smoothed counts there; an unknown word is one of the lowest band's.

The output is factorised: items in order of frequency are cut into classes, about as
many as a class has items. P(item) = P(class) P(item within the class), each normalised
by batched matrix products, so the probabilities of all known words and one unknown word
sum to one, and a token costs the square root of the items.

Training is noise-contrastive estimation in numpy on every token of the training texts,
by tasks side by side, whose parameters are averaged after each of ROUNDS parts of the
slices. As few tasks take part as leave each of them TASK tokens a round, however many
partitions there are, so what a task learns does not fade as a corpus is spread out
more. The model's fit, not its counts, depends a little on how rows are dealt.

Texts are read once: a slice of them becomes numbers of its own distinct words, and each
of these asks once for its count in all training texts. Words are 64-bit hashes.

A null or empty text has the end mark alone. Without training tokens every word is
unknown. Repeated rows are scored, and learned from, each. Columns other than doc_id and
text do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, id_text, remove, slices, written
from .words import word_hashes

END_HASH = np.uint64(0x656E64)
ROOTS = 4  # items for a square root of types
SIZE = 16  # of vectors
NOISE = 10  # samples for each token
DRAWS = 64  # of noise, shared by a batch and weighted to NOISE a token
ROUNDS = 3  # of training, each followed by an average
TASK = 500_000  # tokens that a training task has in a round, at least
BATCH = 4096  # tokens of a step
RATE = 0.15
SEED = 20
SLICE = 6 << 20  # bytes of text whose words are numbered together
_CODEC = "zstd"


def held_out(doc_id):
    """The column that says whether a document is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the tokens: words, then one end mark for each text."""
    offsets, hashes = word_hashes(texts)
    n = len(offsets) - 1
    return offsets + np.arange(n + 1), np.insert(hashes, offsets[1:], END_HASH)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, byte plane by byte plane, compressed."""
    wide = max(1, -(-int(numbers.max() if len(numbers) else 0).bit_length() // 8))
    raw = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].T).tobytes()
    return bytes([wide]) + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    wide = data[0]
    planes = np.zeros((4, n), np.uint8)
    planes[:wide] = np.frombuffer(pa.decompress(data[1:], decompressed_size=wide * n, codec=_CODEC, asbytes=True), np.uint8).reshape(wide, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def numbered(docs: DataFrame) -> DataFrame:
    """Slices of texts, and their words: (slice, word, count) a distinct word, with its count in the slice's training texts, and (slice, n, docs, data) a slice.

    docs has (doc_id, whether it is null, whether held out, tokens) of each text, data the
    numbers of the n tokens' words, in the order of their hashes as signed numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in _joined(slices(batches, "text", SLICE)):
            offsets, hashes = tokens(batch.column("text"))
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            words, own = np.unique(hashes.view(np.int64), return_inverse=True)
            count = np.bincount(own, np.repeat(~held, np.diff(offsets)), len(words)).astype(np.int64)
            ids = batch.column("doc_id")
            about = np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), held, np.diff(offsets)], axis=1).astype(np.int64)
            schema = [("slice", pa.int64()), ("word", pa.int64()), ("count", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("data", pa.binary())]
            for at in range(0, len(words), 1 << 16):
                part = slice(at, at + (1 << 16))
                m = len(words[part])
                rows = [np.full(m, number), words[part], count[part]]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, (_, t) in zip(rows, schema[:3], strict=True)), *(pa.nulls(m, t) for _, t in schema[3:])], names=[c for c, _ in schema])
            whole = [number, None, None, len(hashes), about.tobytes(), _packed(own)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(whole, schema, strict=True)], names=[c for c, _ in schema])
            number += 1
        give_back()

    return docs.mapInArrow(run, "slice long, word long, count long, n long, docs binary, data binary")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together to slices of about SLICE bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > SLICE:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


class Items:
    """The model's items: ``words`` (hashes) with their ``counts``, and bands of the other words, all in order of frequency.

    ``bands`` has, for a power of two, the tokens and types of the other words whose
    counts are that or more, and less than the next.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, bands: dict[int, tuple[int, int]]):
        bands = {0: (0, 0)} | {k: b for k, b in bands.items() if b[1]}
        # An unknown word is one of the lowest band.
        mass = np.array([n + 0.5 * v + 0.5 * (k == 0) for k, (n, v) in bands.items()])
        every = np.concatenate((counts + 0.5, mass))
        order = np.argsort(-every, kind="stable")
        rank = np.empty(len(every), np.int64)
        rank[order] = np.arange(len(every))
        by_hash = np.argsort(words)
        self.words, self.word_items = words[by_hash], rank[: len(words)][by_hash]
        self.band_items, self.band_mass = (np.full(max(bands) + 1, x[len(words)] if x is rank else mass[0]) for x in (rank, mass))
        self.band_items[list(bands)], self.band_mass[list(bands)] = rank[len(words) :], mass
        self.prior = every[order] / every.sum()
        self.n = len(every)
        self.wide = math.isqrt(self.n - 1) + 1  # items of a class

    def of(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, log10 of its share of the item) of words with these counts."""
        band = np.minimum(np.maximum(np.frexp(counts.astype(float))[1] - 1, 0), len(self.band_mass) - 1)
        item, share = self.band_items[band], np.log10((counts + 0.5) / self.band_mass[band])
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            own = self.words[at] == words
            item, share = np.where(own, self.word_items[at], item), np.where(own, 0.0, share)
        return item, share

    @property
    def end(self) -> int:
        at = np.searchsorted(self.words, END_HASH)
        return int(self.word_items[at]) if at < len(self.words) and self.words[at] == END_HASH else int(self.band_items[0])


def contexts(offsets: np.ndarray, items: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The item before each token, and the one before that; before a text's start, the end mark."""
    one = np.concatenate(([end], items))[: len(items)]
    two = np.concatenate(([end, end], items))[: len(items)]
    starts = offsets[:-1]
    one[starts] = two[starts] = end
    two[starts[np.diff(offsets) > 1] + 1] = end
    return one, two


class LogBilinear:
    """Vectors of items as context (r) and as target (t, b), of classes (u, d), and two context maps."""

    def __init__(self, prior: np.ndarray, wide: int, size: int = SIZE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = len(prior)
        self.prior, self.wide = prior, wide
        self.class_prior = np.add.reduceat(prior, np.arange(0, n, wide))
        m = len(self.class_prior)
        self.p = {
            "r": rng.normal(0, 0.3, (n, size)),
            "c1": np.eye(size),
            "c2": 0.5 * np.eye(size),
            "t": rng.normal(0, 0.1, (n, size)),
            "b": np.log(prior)[:, None],
            "u": rng.normal(0, 0.1, (m, size)),
            "d": np.log(self.class_prior)[:, None],
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, state: dict, rng: np.random.Generator, rate: float = RATE) -> None:
        """Noise-contrastive estimation on these tokens, in steps of BATCH: tell items and classes from NOISE draws of their priors."""
        bounds = np.cumsum(self.prior)
        log_noise = np.log(NOISE * self.prior).astype(np.float32)
        log_class = np.log(NOISE * self.class_prior).astype(np.float32)
        expected = (NOISE * self.class_prior).astype(np.float32)
        p = self.p
        for at in range(0, len(word), BATCH):
            a, b, w = (x[at : at + BATCH] for x in (one, two, word))
            c = w // self.wide
            other = np.minimum(np.searchsorted(bounds, rng.random(DRAWS) * bounds[-1], side="right"), len(bounds) - 1)
            v1, v2 = p["r"][a], p["r"][b]
            q = v1 @ p["c1"] + v2 @ p["c2"]
            t_w, t_o = p["t"][w], p["t"][other]
            true = _off(np.einsum("ij,ij->i", q, t_w) + p["b"][w, 0] - log_noise[w])
            false = _off(log_noise[other] - p["b"][other, 0] - q @ t_o.T)
            false *= np.float32(-NOISE / DRAWS)
            # Of classes there are few: their noise is taken in expectation.
            per_class = q @ -p["u"].T
            per_class += log_class - p["d"][:, 0]
            mine = np.arange(len(w)), c
            own = _off(-per_class[mine])
            per_class = _off(per_class)
            per_class *= -expected
            per_class[mine] += own
            d_q = true[:, None] * t_w + false @ t_o + per_class @ p["u"]
            self._step(state, "u", None, per_class.T @ q, rate)
            self._step(state, "d", None, per_class.sum(axis=0)[:, None], rate)
            self._step(state, "t", np.concatenate((w, other)), np.concatenate((true[:, None] * q, false.T @ q)), rate)
            self._step(state, "b", np.concatenate((w, other)), np.concatenate((true, false.sum(axis=0)))[:, None], rate)
            d_1, d_2 = d_q @ p["c1"].T, d_q @ p["c2"].T
            self._step(state, "c1", None, v1.T @ d_q, 0.1 * rate)
            self._step(state, "c2", None, v2.T @ d_q, 0.1 * rate)
            self._step(state, "r", np.concatenate((a, b)), np.concatenate((d_1, d_2)), rate)

    def _step(self, state: dict, name: str, rows: np.ndarray | None, grad: np.ndarray, rate: float) -> None:
        """A step of Adagrad; with ``rows``, of these rows alone, gradients of equal ones added up."""
        grad = grad / np.float32(BATCH)
        if rows is not None:
            order = np.argsort(rows.astype(np.uint16) if len(self.prior) <= 1 << 16 else rows, kind="stable")
            rows = rows[order]
            first = np.flatnonzero(np.concatenate(([True], np.diff(rows) != 0)))
            rows, grad = rows[first], np.add.reduceat(grad[order], first, axis=0)
        at = slice(None) if rows is None else rows
        seen = state.setdefault(name, np.full(self.p[name].shape, 1e-8, np.float32))
        seen[at] += grad * grad
        self.p[name][at] += np.float32(rate) * grad / np.sqrt(seen[at])

    def log10(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token: of its class, and of it within the class."""
        p, out = self.p, np.empty(len(word))
        first, second = p["r"] @ p["c1"], p["r"] @ p["c2"]
        step = 1 << 13
        for at in range(0, len(word), step):
            q = first[one[at : at + step]] + second[two[at : at + step]]
            w = word[at : at + step]
            c = w // self.wide
            own = _of(q @ p["u"].T + p["d"][:, 0], c)
            order = np.argsort(c, kind="stable")
            cuts = np.searchsorted(c[order], np.arange(len(p["u"]) + 1)).tolist()
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    rows, low = order[a:b], k * self.wide
                    own[rows] += _of(q[rows] @ p["t"][low : low + self.wide].T + p["b"][low : low + self.wide, 0], w[rows] - low)
            out[at : at + step] = own
        return out / math.log(10)


def _off(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in the place of ``x``."""
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _of(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Natural log of the softmax of each row at the chosen column."""
    scores -= scores.max(axis=1, keepdims=True)
    own = scores[np.arange(len(chosen)), chosen].astype(np.float64)
    np.exp(scores, out=scores)
    return own - np.log((scores @ np.ones(scores.shape[1], np.float32)).astype(np.float64))


def _averaged(model: LogBilinear, rows: DataFrame, number: int, end: int) -> None:
    """Trains the model on the slices of one round, task by task from the same start, and takes the average of what they find."""
    block = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, state, seen = np.random.default_rng((SEED, number, TaskContext.get().partitionId())), {}, 0
        for batch in batches:
            for n, about, data in zip(*(batch.column(c).to_pylist() for c in ("n", "docs", "data")), strict=True):
                items, about = _unpacked(data, n), np.frombuffer(about, np.int64).reshape(-1, 4)
                offsets = np.concatenate(([0], np.cumsum(about[:, 3])))
                one, two = contexts(offsets, items, end)
                learn = np.flatnonzero(np.repeat(about[:, 2] == 0, about[:, 3]))
                rng.shuffle(learn)
                model.fit(one[learn], two[learn], items[learn], state, rng, RATE / (1 + number))
                seen += len(learn)
        if seen:
            flat = np.concatenate([v.ravel() for v in model.p.values()])
            parts = [flat[k : k + block].astype(np.float64) * seen for k in range(0, len(flat), block)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([seen] * len(parts), pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in parts], pa.binary())], names=["part", "seen", "data"])
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for part, seen, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seen", "data")), strict=True):
                had, total = sums.get(part, (0, 0.0))
                sums[part] = had + seen, total + np.frombuffer(data, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.astype(np.float32).tobytes() for _, x in sums.values()], pa.binary())], names=["part", "seen", "data"])

    schema = "part long, seen long, data binary"
    found = rows.mapInArrow(run, schema).repartition("part").mapInArrow(add, schema).collect()  # one row a part of the parameters
    if not found:
        return
    flat = np.concatenate([np.frombuffer(r["data"], np.float32) / r["seen"] for r in sorted(found, key=lambda r: r["part"])])
    at = 0
    for k, v in model.p.items():
        model.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size


def learned(docs: DataFrame) -> tuple[DataFrame, LogBilinear, Items, int]:
    """(slices, model, items, training tokens): (n, docs, data, figures) of each slice, data its tokens' items, figures its texts' n_known, base score and shares."""
    rows = id_text(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    stored = written(numbered(rows), "numbered")
    asked = stored.where("word is not null").select("slice", "word", "count")
    totals = written(asked.groupBy("word").agg(F.sum("count").alias("total")), "totals")
    sums = totals.agg(F.sum("total").alias("n"), F.sum((F.col("total") > 0).cast("long")).alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    whole = n + 0.5 * (v + 1)
    known = totals.where("total > 0")
    # Words of equal counts in the order of hashes as whole numbers.
    top = known.orderBy(F.desc("total"), "word").limit(min(v, ROOTS * (math.isqrt(max(v - 1, 0)) + 1))).collect() if v else []
    words, counts = (np.array([r[c] for r in top], np.int64) for c in ("word", "total"))
    band = (F.length(F.bin("total")) - 1).cast("int")
    bands = {r["band"]: [r["n"], r["v"]] for r in known.groupBy(band.alias("band")).agg(F.sum("total").alias("n"), F.count("*").alias("v")).collect()}
    for c in counts.tolist():
        bands[c.bit_length() - 1][0] -= c
        bands[c.bit_length() - 1][1] -= 1
    items = Items(words.view(np.uint64), counts, {k: (tokens, types) for k, (tokens, types) in bands.items()})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a slice, its words with their totals come in order, then the slice itself."""
        words, totals = [], []
        for batch in batches:
            last = 0
            for i in np.flatnonzero(batch.column("n").is_valid().to_numpy(zero_copy_only=False)).tolist() + [batch.num_rows]:
                part = batch.slice(last, i - last)
                words.append(part.column("word").to_numpy(zero_copy_only=False))
                totals.append(part.column("total").to_numpy(zero_copy_only=False))
                last = i + 1
                if i == batch.num_rows:
                    break
                size, about, data = (batch.column(c)[i].as_py() for c in ("n", "docs", "data"))
                word, count = (np.concatenate(x).astype(np.int64) for x in (words, totals))
                words, totals = [], []
                own = _unpacked(data, size)
                item, share = items.of(word.view(np.uint64), count)
                about = np.frombuffer(about, np.int64).reshape(-1, 4)
                starts = np.cumsum(about[:, 3]) - about[:, 3]
                base = np.log10((count + 0.5) / whole)
                figures = np.stack([np.add.reduceat(x[own], starts) for x in ((count > 0).astype(float), base, share)], axis=1)
                values = [size, about.tobytes(), _packed(item[own]), figures.tobytes()]
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=["n", "docs", "data", "figures"])
        give_back()

    answers = asked.select("slice", "word").join(totals, "word").select("slice", "word", "total", *(F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("docs", "binary"), ("data", "binary"))))
    rest = stored.where("n is not null").select("slice", F.lit(None).cast("long").alias("word"), F.lit(None).cast("long").alias("total"), "n", "docs", "data")
    met = answers.unionByName(rest).repartition("slice").sortWithinPartitions("slice", F.col("word").asc_nulls_last())
    done = written(met.mapInArrow(answer, "n long, docs binary, data binary, figures binary"), "items")
    for table in (stored, totals):
        remove(docs.sparkSession, table)
    model = LogBilinear(items.prior, items.wide)
    if n:
        tasks = max(1, n // (ROUNDS * TASK))
        for k in range(ROUNDS):
            _averaged(model, done.where(F.pmod(F.xxhash64("docs"), F.lit(ROUNDS)) == k).coalesce(tasks), k, items.end)
    return done, model, items, n


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    done, model, items, train = learned(docs)
    end = items.end

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, about, data, figures in zip(*(batch.column(c).to_pylist() for c in ("n", "docs", "data", "figures")), strict=True):
                own, about, figures = _unpacked(data, n), np.frombuffer(about, np.int64).reshape(-1, 4), np.frombuffer(figures).reshape(-1, 3)
                offsets = np.concatenate(([0], np.cumsum(about[:, 3])))
                full = np.add.reduceat(model.log10(*contexts(offsets, own, end), own), offsets[:-1]) + figures[:, 2]
                columns = {
                    "doc_id": pa.array(about[:, 0], mask=about[:, 1].astype(bool)),
                    "held_out": pa.array(about[:, 2].astype(bool)),
                    "n_tokens": pa.array(about[:, 3]),
                    "n_known": pa.array(figures[:, 0].astype(np.int64)),
                    "train_tokens": pa.array(np.full(len(about), train, np.int64)),
                    "base_score": pa.array(figures[:, 1]),
                    "score": pa.array(full),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        give_back()

    return done.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
