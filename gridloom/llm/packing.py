"""Best-fit packing planned over the histogram of lengths.

The plan is made from counts of lengths alone (at most ``capacity`` of them):
lengths in falling order, each into the open sequences with the least room that
still holds it. It says, for ranges of ranks within a length, which sequences
and places they get; documents then take their places by a join on length and
rank. Its size depends on ``capacity`` only: a sequence pattern holds fewer than
sqrt(2 * capacity) different lengths and a length splits at most two ranges of
like sequences, so it has under 2 * capacity * sqrt(2 * capacity) rows.

A null text is empty and gives one piece, the end mark alone. Repeated rows are
packed each. An empty table gives an empty result. Columns other than doc_id
and text do not matter.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_text, slices, written
from .words import split

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"


class WordTokenizer:
    """Token ids of whole texts, each different word part tokenized once.

    For the public word tokenizer: pieces never reach across ASCII white space, which
    it drops, it lower-cases, and it splits letters from punctuation. A word of letters
    and the ASCII punctuation after it are two parts; parts are encoded many at a time
    with spaces between, and each ends with the one token that closes a word. All other
    words are encoded whole, with a special token between them.
    """

    GROUP, MOST = 2000, 600_000
    TAIL = ".,;:!?\"()[]{}*/\\-_+=#$%&@^~`"

    def __init__(self, path: str, mark: str = "<|startoftext|>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.mark_id = mark, self.tokenizer.token_to_id(mark)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        """Slot 0 is the empty part."""
        self.parts: dict[str, int] = {"": 0}
        self.pool, self.ends = np.zeros(0, np.int32), np.zeros(2, np.int64)

    def _encoded(self, joined: list[str]) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        return np.array([i for f in found for i in f.ids], np.int32)

    def _learn(self, parts: list[str]) -> None:
        plain = [p for p in parts if p.isalpha() or not p.strip(self.TAIL)]
        ids = self._encoded([" ".join(plain[k : k + self.GROUP]) for k in range(0, len(plain), self.GROUP)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(plain):  # a part that is no single word to the tokenizer
            plain, ids, ends = [], ids[:0], ends[:0]
        fast = set(plain)
        odd = [p for p in parts if p not in fast]
        alone = [p for p in odd if self.mark in p]
        odd = [p for p in odd if self.mark not in p]
        marked = self._encoded([self.mark.join([*odd[k : k + self.GROUP], ""]) for k in range(0, len(odd), self.GROUP)])
        border = marked == self.mark_id
        at = np.flatnonzero(border)
        pool, all_ends = [ids, marked[~border]], [ends, len(ids) + at - np.arange(len(at))]
        done = sum(map(len, pool))
        for p in alone:
            pool.append(np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.int32))
            done += len(pool[-1])
            all_ends.append(np.array([done]))
        for k, p in enumerate([*plain, *odd, *alone], len(self.parts)):
            self.parts[p] = k
        self.ends = np.concatenate([self.ends, *(e + len(self.pool) for e in all_ends)])
        self.pool = np.concatenate([self.pool, *pool])

    def _slots(self, parts: pa.Array) -> np.ndarray:
        found = parts.dictionary_encode()
        distinct = found.dictionary.to_pylist()
        if new := [p for p in distinct if p not in self.parts]:
            self._learn(new)
        known = self.parts
        return np.fromiter((known[p] for p in distinct), np.int64, len(distinct))[found.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, without end marks. Special tokens in a text are what the tokenizer makes of them."""
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        offsets, values = split(texts, lower=not special)
        if not len(values):
            return offsets, np.zeros(0, np.int32)
        found = values.dictionary_encode()
        words = found.dictionary
        if len(self.parts) + len(words) > self.MOST:
            self.forget()
        stems = pc.ascii_rtrim(words, characters=self.TAIL)
        stems = pc.if_else(pc.utf8_is_alpha(stems), stems, words)
        cut = pc.binary_length(stems).to_numpy()
        tailed = np.flatnonzero(cut < pc.binary_length(words).to_numpy())
        tails = [w.encode()[k:].decode() for w, k in zip(words.take(pa.array(tailed)).to_pylist(), cut[tailed].tolist(), strict=True)]
        slots = np.zeros((len(words), 2), np.int64)
        slots[:, 0] = self._slots(stems)
        slots[tailed, 1] = self._slots(pa.array(tails, pa.string()))
        slots = slots[found.indices.to_numpy()].ravel()
        start, size = self.ends[slots], self.ends[slots + 1] - self.ends[slots]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.arange(total[-1]) + np.repeat(start - total[:-1], size)]
        return total[2 * offsets], ids


@lru_cache(1)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker."""
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for batch in slices(batches, "text", 16 << 20):
            offsets, ids = tokenizer.encode(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for i, doc in enumerate(doc_ids):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.int32(END)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)], names=names[:n])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return id_text(docs).mapInArrow(run, schema)


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank from, rank to, first sequence, items a sequence, place of the first item).

    Item r of a length, r counted from 0, is in sequence first + (r - from) // items,
    at place + (r - from) % items * length.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, sequences)
    rooms: list[int] = []
    made = 0

    def give(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                bisect.insort(rooms, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                free = rooms[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], rooms[at]
            else:
                free, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = free // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - free))
                give(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                plan.append((length, rank, rank + left, first + full, left, capacity - free))
                give(free - left * length, first + full, 1)
                give(free, first + full + 1, n - full - 1)
                left = 0
            elif full < n:
                give(free, first + full, n - full)
    return plan


def packed(pieces: DataFrame, capacity: int = CAPACITY, chunk_rows: int = 100_000) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Ranks within a length are counted in chunks, so that a length that many pieces
    share is no single task; the chunks' counts are summed up before them.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    chunks = max(8, -(-max(counts.values(), default=0) // chunk_rows))
    schema = "p_length long, lo long, hi long, first long, each long, place long"
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), schema)
    dealt = pieces.withColumn("__chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)).cast("int"))
    before = (
        dealt.groupBy("length", "__chunk")
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("length").alias("b_length"), F.col("__chunk").alias("b_chunk"), F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    rank = F.row_number().over(Window.partitionBy("length", "__chunk").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = (
        dealt.withColumn("__in", rank)
        .join(before, (F.col("length") == F.col("b_length")) & (F.col("__chunk") == F.col("b_chunk")))
        .withColumn("__rank", F.col("__in") + F.col("__before"))
    )
    # The plan's size is bounded by the capacity, whatever the input.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    by = F.col("__rank") - F.col("lo")
    return placed.select(
        *pieces.columns,
        (F.col("first") + F.expr("(__rank - lo) div each")).alias("sequence_id"),
        (F.col("place") + by % F.col("each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut what is longer than ``capacity``, and pack: one row a piece."""
    return packed(written(token_pieces(docs, path, capacity, with_ids=False), "pieces"), capacity)
