"""Words and word shingles of whole texts as 64-bit hashes, batch by batch.

A word is a run of anything but ASCII space and U+0009 to U+000D, after A-Z are
lower-cased. Hashes are equal on every machine and in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += _GOLD
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), _GOLD))))


def split(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): text i has words offsets[i]:offsets[i+1]. Null and blank texts have none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    values, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(values), 0)
    kept = keep.to_numpy(zero_copy_only=False)
    if not kept.all():
        offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
        values = values.filter(keep)
    return offsets, values


_AT_ONCE = 1 << 20  # bytes whose terms are held at a time


def hash_words(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of ``values`` (none null or empty)."""
    if not len(values):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    sizes = np.diff(ends)
    out = np.empty(len(sizes), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + _AT_ONCE, side="right")) - 1)
            if to == at + 1:
                out[at] = _sum_of(data[ends[at] : ends[to]])
            else:
                starts = ends[at:to] - ends[at]
                place = np.arange(ends[to] - ends[at]) - np.repeat(starts, sizes[at:to])
                terms = _powers(int(sizes[at:to].max()))[place] * _BYTE[data[ends[at] : ends[to]]]
                out[at:to] = np.add.reduceat(terms, starts)
            at = to
        return mix(out + sizes.astype(np.uint64))


def _sum_of(word: np.ndarray) -> np.uint64:
    """The sum of one word's terms, some bytes at a time."""
    powers, total, scale = _powers(min(len(word), _AT_ONCE)), np.uint64(0), np.uint64(1)
    for k in range(0, len(word), _AT_ONCE):
        part = word[k : k + _AT_ONCE]
        total += scale * (powers[: len(part)] * _BYTE[part]).sum(dtype=np.uint64)
        scale *= powers[-1] * _GOLD
    return total


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the words of each text."""
    offsets, values = split(texts)
    return offsets, hash_words(values)


def shingles(offsets: np.ndarray, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the ``size``-word shingles by position.

    A text of fewer words has one shingle, the whole sequence; a text without words has none.
    """
    n = np.diff(offsets)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
        for k in range(size):
            rolled = rolled * _GOLD + mix(hashes[k : k + len(rolled)] + np.uint64(k))
    rolled = mix(rolled)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_offsets = np.concatenate(([0], np.cumsum(counts)))
    whole = n >= size
    source = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1] - offsets[:-1], counts)
    out = np.zeros(int(out_offsets[-1]), np.uint64)
    long = np.repeat(whole, counts)
    out[long] = rolled[source[long]]
    for i in np.flatnonzero(~whole & (n > 0)):
        value = np.uint64(n[i])
        with np.errstate(over="ignore"):
            for h in hashes[offsets[i] : offsets[i + 1]]:
                value = mix(np.array([value * _GOLD + h]))[0]
        out[out_offsets[i]] = value
    return out_offsets, out
