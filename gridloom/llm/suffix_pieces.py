"""SentencePiece encoding and decoding by suffix-array matching.

A batch's different words are put end to end and indexed by a suffix array (to
the depth of the longest piece). Every piece is looked up by binary search; its
range of suffixes gives all places where it occurs, as edges. The edges, sorted
by where they end, are relaxed from left to right: of the edges that end at a
place, the one that can follow the encoding of the prefix before it is the last
piece of this prefix's encoding. For byte-pair models that is the edge whose
pair with the piece before is stable: while both are built up by their merges,
no merge across the border comes first. Going back from a word's end gives its
pieces. Characters that no piece holds fall back to bytes.

Words end before a space mark that follows another character, and at line feeds;
the model is checked to have no piece across these borders. Null texts are
empty, and empty texts have no ids. Repeated rows give repeated results.
Columns other than doc_id and text do not matter.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import id_text, slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_PART = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_NONE = -1


class PieceModel:
    """Pieces of a byte-pair SentencePiece model and how each is merged."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("the model is not a byte-pair model with identity normalization and a dummy prefix")
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.id = {p: i for i, p in enumerate(self.pieces) if kinds[i] == 1}
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.id):
            raise ValueError("a piece reaches across words")
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(self.pieces):
            if kinds[i] == 6:
                self.byte_id[int(p[3:-1], 16)] = i
        n = len(self.pieces)
        # Rank of a piece: when it is merged, best score first. Single characters are there from the start.
        order = sorted(self.id.values(), key=lambda i: (-proto.pieces[i].score, i))
        self.rank = np.full(n + 1, np.iinfo(np.int64).max)
        self.rank[order] = np.arange(len(order))
        self.size = np.ones(n + 1, np.int64)
        for p, i in self.id.items():
            self.size[i] = len(p)
        self.left, self.right = np.full(n + 1, _NONE, np.int64), np.full(n + 1, _NONE, np.int64)
        self.stable = np.zeros(n + 1, bool)  # whether a piece's own encoding is itself
        for p, i in self.id.items():
            self._derive(p, i)
        joins = {(self.id[p[:k]] * n + self.id[p[k:]]): i for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id}
        self.join_codes = np.array(sorted(joins), np.int64)
        self.join_rank = np.array([self.rank[joins[c]] for c in self.join_codes.tolist()], np.int64)
        self.n = n
        # Most pairs join to no piece; a table of hashed pairs says so at once.
        self.may_join = np.zeros(1 << 22, bool)
        self.may_join[self._hashed(self.join_codes)] = True
        alphabet = sorted({c for p in self.id for c in p})
        self.symbol = {ord(c): k + 1 for k, c in enumerate(alphabet)}
        self.depth = max(map(len, self.id))
        self.keys = np.array([b"".join(self._code(self.symbol[ord(c)]) for c in p) for p in self.id])
        self.key_ids = np.array(list(self.id.values()), np.int64)
        width = f"S{2 * self.depth}"
        self.low_keys = self.keys.astype(width)
        # What follows all suffixes that begin with the piece; a piece of full depth has no room for that mark.
        self.high_keys = np.array([k + b"\xff" if len(k) < 2 * self.depth else k for k in self.keys.tolist()], width)
        self.full = np.flatnonzero(self.size[self.key_ids] == self.depth)
        self.bytes = [bytes([int(p[3:-1], 16)]) if kinds[i] == 6 else p.replace(SPACE, " ").encode() if kinds[i] == 1 else b"" for i, p in enumerate(self.pieces)]

    @staticmethod
    def _code(symbol: int) -> bytes:
        """Two bytes without zeros, in the symbols' order; (1, 1) is no symbol of a piece."""
        return bytes([1 + symbol // 254, 1 + symbol % 254])

    def _derive(self, piece: str, i: int) -> None:
        """Merge the piece's characters, best pair first and leftmost of equal ones, and keep the last merge."""
        parts = list(piece)
        last = (None, None)
        while len(parts) > 1:
            best = min(((self.rank[self.id[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.id), default=None)
            if best is None:
                return
            k = best[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        self.stable[i] = True
        if last[0] is not None:
            self.left[i], self.right[i] = self.id[last[0]], self.id[last[1]]

    @staticmethod
    def _hashed(codes: np.ndarray) -> np.ndarray:
        return (codes * 0x9E3779B1 >> 7) & ((1 << 22) - 1)

    def pairs_stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece a then piece b stay two, for arrays of pieces; _NONE is a character outside all pieces."""
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a != _NONE) & (b != _NONE))
        x, y = a[live], b[live]
        # Going back in time, x and y are what stands at the border; they stood there until ``until``.
        never = np.iinfo(np.int64).max
        until_x, until_y = np.full(len(x), never), np.full(len(x), never)
        while len(live):
            code = x * self.n + y
            rank = np.full(len(x), never)
            some = np.flatnonzero(self.may_join[self._hashed(code)])
            at = np.minimum(np.searchsorted(self.join_codes, code[some]), len(self.join_codes) - 1)
            rank[some] = np.where(self.join_codes[at] == code[some], self.join_rank[at], never)
            # Of equal merges the leftmost comes first: x's own before the border's, the border's before y's.
            bad = (rank != never) & (rank < until_x) & (rank <= until_y)
            out[live[bad]] = False
            whole_x, whole_y = self.left[x] == _NONE, self.left[y] == _NONE
            keep = ~bad & ~(whole_x & whole_y)
            live, x, y, until_x, until_y, whole_x, whole_y = (v[keep] for v in (live, x, y, until_x, until_y, whole_x, whole_y))
            # The later merge is undone first; of equal ones y's, which is further right.
            back_x = ~whole_x & (whole_y | (self.rank[x] > self.rank[y]))
            until_x = np.where(back_x, self.rank[x], until_x)
            until_y = np.where(back_x, until_y, self.rank[y])
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return out


class Encoder:
    """Encodes batches; what a word encodes to is kept, up to MOST words."""

    MOST, AT_ONCE = 900_000, 60_000
    LONG, CHARACTERS = 512, 1 << 18  # characters of a long word, and of what is indexed at once

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.table = np.zeros(0x110000, np.uint16)
        for c, s in self.model.symbol.items():
            self.table[c] = s
        sizes = np.array([len(b) for b in self.model.bytes], np.int64)
        self.byte_size, self.byte_start = sizes, np.concatenate(([0], np.cumsum(sizes)))
        self.byte_pool = np.frombuffer(b"".join(self.model.bytes), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def edges(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece in words put end to end, without borders between them."""
        m = self.model
        symbols = self.table[points].astype(np.int64)
        gap = np.zeros(len(points) + len(ends), np.int64)  # a symbol of no piece after each word
        word = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
        place = np.arange(len(points)) + word
        gap[place] = symbols
        coded = np.ones((len(gap) + m.depth, 2), np.uint8)
        coded[: len(gap), 0] = 1 + gap // 254
        coded[: len(gap), 1] = 1 + gap % 254
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(coded.ravel(), 2 * m.depth)[::2][place]).view(f"S{2 * m.depth}").ravel()
        order = np.argsort(suffixes, kind="stable")
        ranked = suffixes[order]
        low = np.searchsorted(ranked, m.low_keys, side="left")
        high = np.searchsorted(ranked, m.high_keys, side="left")
        high[m.full] = np.searchsorted(ranked, m.low_keys[m.full], side="right")
        n = np.maximum(high - low, 0)
        at = order[np.arange(n.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(n)))[:-1], n)]
        return at, np.repeat(m.key_ids, n)

    def _learn(self, words: list[str]) -> None:
        m = self.model
        ends = np.cumsum([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], ends[:-1]))
        at, piece = self.edges(points, ends)
        good = m.stable[piece]
        at, piece = at[good], piece[good]
        word = np.searchsorted(ends, at, side="right")
        stop = at - starts[word] + m.size[piece]  # where the edge ends in its word
        order = np.argsort(stop, kind="stable")
        at, piece, word, stop = at[order], piece[order], word[order], stop[order]
        last = np.full(len(points), _NONE, np.int64)  # the last piece of the encoding up to and with a character
        bounds = np.searchsorted(stop, np.arange(1, int(stop[-1]) + 2)) if len(stop) else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, p = at[a:b], piece[a:b]
            first = s == starts[word[a:b]]
            ok = first | m.pairs_stable(np.where(first, _NONE, last[s - 1]), p)
            last[s[ok] + m.size[p[ok]] - 1] = p[ok]
        # Back from each word's end; ids are gathered from the right.
        now, chains = ends - 1, []
        live = np.flatnonzero(ends > starts)
        while len(live):
            own = last[now[live]]
            chains.append((live, own, now[live]))
            now[live] = now[live] - m.size[own]
            live = live[now[live] >= starts[live]]
        word = np.concatenate([c[0] for c in chains])
        ids = np.concatenate([c[1] for c in chains])
        place = np.concatenate([c[2] for c in chains])
        order = np.argsort(place, kind="stable")
        word, ids, place = word[order], ids[order], place[order]
        flat, count = self._with_bytes(ids, points[place])
        sizes = np.bincount(word, weights=count, minlength=len(words)).astype(np.int64)
        for k, w in enumerate(words, len(self.known)):
            self.known[w] = k
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        self.pool = np.concatenate((self.pool, flat.astype(np.int32)))

    def _with_bytes(self, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each was) with the bytes of the characters that no piece holds."""
        count = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids == _NONE)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[odd].tolist()]
        count[odd] = [len(r) for r in raw]
        flat = np.repeat(ids, count)
        if len(odd):
            spots = (np.cumsum(count) - count)[odd]
            where = np.arange(int(count[odd].sum())) + np.repeat(spots - np.concatenate(([0], np.cumsum(count[odd])))[:-1], count[odd])
            flat[where] = self.model.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return flat, count

    def _learn_long(self, text: str) -> None:
        """One long word, indexed part by part; which pieces may follow which is worked out for a part at once, then its places are passed once."""
        m, points = self.model, np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(points)
        last, chosen = [_NONE] * (n + 1), [_NONE] * (n + 1)  # piece that ends the encoding of a prefix, and its number among the edges that end there
        late = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # edges (start, piece) that end in the next part
        was = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # edges (stop, piece) that end shortly before this part
        for low in range(0, n, self.CHARACTERS):
            high = min(low + self.CHARACTERS, n)
            at, piece = self.edges(points[low : high + m.depth], np.array([min(high + m.depth, n) - low]))
            keep = m.stable[piece] & (at < high - low)
            at, piece = np.concatenate((late[0], at[keep] + low)), np.concatenate((late[1], piece[keep]))
            stop = at + m.size[piece]
            late = (at[stop > high], piece[stop > high])
            now = np.flatnonzero(stop <= high)
            now = now[np.argsort(stop[now], kind="stable")]
            at, piece, stop = at[now], piece[now], stop[now]
            stops, pieces = np.concatenate((was[0], stop)), np.concatenate((was[1], piece))
            a, b = np.searchsorted(stops, at, side="left"), np.searchsorted(stops, at, side="right")
            before = np.where(at > 0, b - a, 0)
            base = np.cumsum(before) - before
            pairs = pieces[np.arange(int(before.sum())) + np.repeat(a - base, before)] * m.n + np.repeat(piece, before)
            code, of = np.unique(pairs, return_inverse=True)
            stable = m.pairs_stable(code // m.n, code % m.n)[of].tobytes()
            edge = 0
            ends = stop.tolist()
            for k, (start, p, first) in enumerate(zip(at.tolist(), piece.tolist(), base.tolist(), strict=True)):
                end = ends[k]
                if k and ends[k - 1] != end:
                    edge = k
                j = chosen[start]
                if start == 0 or j < 0 or stable[first + j]:
                    last[end], chosen[end] = p, k - edge
            near = stops > high - m.depth
            was = (stops[near], pieces[near])
        ids, place, size = [], [], m.size.tolist()
        while n:
            ids.append(last[n])
            n -= size[last[n]]
            place.append(n)
        flat, _ = self._with_bytes(np.array(ids[::-1], np.int64), points[np.array(place[::-1])])
        self.known[text] = len(self.known)
        self.ends = np.append(self.ends, self.ends[-1] + len(flat))
        self.pool = np.concatenate((self.pool, flat.astype(np.int32)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        values, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        found = values.dictionary_encode()
        index = found.indices.to_numpy()
        words = found.dictionary.to_pylist()
        # Each word has a space mark before it; a text that is empty has not even that.
        blank = np.array([w == "" or SPACE in w for w in words] or [False])
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(offsets, np.flatnonzero(blank[index]), side="right") - 1] = True
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        whole = {i: _PART.findall(SPACE + t.as_py().replace(" ", SPACE)) for i, t in ((i, texts[i]) for i in np.flatnonzero(odd & ~empty).tolist())}
        split = [[] if b else _PART.findall(SPACE + w) if "\n" in w else (SPACE + w,) for w, b in zip(words, blank.tolist(), strict=False)]
        if len(self.known) + len(split) > self.MOST:
            self.forget()
        new = dict.fromkeys(p for parts in (*split, *whole.values()) for p in parts if p not in self.known)
        short = [p for p in new if len(p) <= self.LONG]
        size = np.cumsum([len(p) for p in short])
        k = 0
        while k < len(short):  # the index and edges of so many words and characters at a time
            done = size[k - 1] if k else 0
            to = max(k + 1, min(k + self.AT_ONCE, int(np.searchsorted(size, done + self.CHARACTERS, side="right"))))
            self._learn(short[k:to])
            k = to
        for p in new:
            if len(p) > self.LONG:
                self._learn_long(p)
        known = self.known
        counts = np.array([len(s) for s in split] or [0], np.int64)
        slots = np.fromiter((known[p] for s in split for p in s), np.int64, int(counts.sum()))
        part_start = np.concatenate(([0], np.cumsum(counts)))
        n = counts[index] if len(index) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(n)))
        flow = slots[np.arange(total[-1]) + np.repeat(part_start[index] - total[:-1], n)]
        edges = total[offsets]
        if whole or empty.any():
            rows = [np.array([known[p] for p in whole[i]], np.int64) if i in whole else flow[:0] if empty[i] else flow[edges[i] : edges[i + 1]] for i in range(len(texts))]
            flow, edges = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        start, size = self.ends[flow], self.ends[flow + 1] - self.ends[flow]
        total = np.concatenate(([0], np.cumsum(size)))
        return total[edges], self.pool[np.arange(total[-1]) + np.repeat(start - total[:-1], size)]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """UTF-8 of each text's ids; the space that encoding put first is taken off. Bytes that are no UTF-8 stay as they are."""
        size = self.byte_size[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        flat = self.byte_pool[np.arange(total[-1]) + np.repeat(self.byte_start[ids] - total[:-1], size)]
        cuts = total[offsets].tolist()
        out = [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [o[1:] if o[:1] == b" " else o for o in out]


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in slices(batches, "text"):
            offsets, ids = encoder.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null ids: empty); bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
            texts = encoder.decode(offsets, np.concatenate([np.zeros(0, np.int64), *ids]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts])], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), decoded_sha256 and lossless (decoding gives the text) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in slices(batches, "text", 12 << 20):
            offsets, ids = encoder.encode(batch.column("text"))
            back = encoder.decode(offsets, ids)
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            same = [b == t.encode() for b, t in zip(back, batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array(same)],
                names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "lossless"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")
