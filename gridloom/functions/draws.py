"""The draws of ``prng`` for many places of many keys at once: MD5 of short texts, in numpy, inside tasks."""

from __future__ import annotations

import math

import numpy as np

_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
MOST = 55  # bytes of a text that fill one block


def _md5_words(words: np.ndarray) -> np.ndarray:
    """The digests, as four words each, of blocks of sixteen words (16, n)."""
    a0, b0, c0, d0 = (np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    n = words.shape[1]
    a, b, c, d = (np.full(n, x, np.uint32) for x in (a0, b0, c0, d0))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turn, k = divmod(i, 16)
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = k
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * k + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * k + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * k % 16
        f += a
        f += np.uint32(_SINES[i])
        f += words[g]
        s = (7, 12, 17, 22, 5, 9, 14, 20, 4, 11, 16, 23, 6, 10, 15, 21)[4 * turn + i % 4]
        np.right_shift(f, np.uint32(32 - s), out=t)
        f <<= np.uint32(s)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return np.stack([a + a0, b + b0, c + c0, d + d0])


class Draws:
    """The first two words of MD5 of ``seed:key:place`` for keys (as bytes) and places."""

    def __init__(self, seed: str, keys: np.ndarray):
        head, width = seed.encode() + b":", keys.dtype.itemsize
        raw = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), width)
        self.sizes, self.rows = len(head) + (raw != 0).sum(axis=1), np.arange(len(keys))
        self.text = np.zeros((len(keys), 64), np.uint8)
        self.text[:, : len(head)] = np.frombuffer(head, np.uint8)
        self.text[:, len(head) : len(head) + width] = raw

    def at(self, place: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Digits 1 to 8, and 9 to 16, at a place; of all keys, or of some."""
        tail = f":{place}".encode()
        text, sizes, rows = self.text, self.sizes, self.rows
        if chosen is not None:
            text, sizes, rows = text[chosen], sizes[chosen], np.arange(len(chosen))
        for k, letter in enumerate(tail + b"\x80"):
            text[rows, sizes + k] = letter
        words = np.ascontiguousarray(text.view("<u4").T)
        words[14] = 8 * (sizes + len(tail))
        made = _md5_words(words)
        return made[0].byteswap(), made[1].byteswap()


def fits(seed: str, width: int, places: int) -> bool:
    return len(seed) + width + len(str(places)) + 2 <= MOST
