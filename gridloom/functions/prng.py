"""Random numbers that depend on a seed and keys alone: the same under any partitioning and in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = "0123456789abcdef"
BASES = "ACGT"


def digest(seed: object, *keys: Column) -> Column:
    """32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)).cast("binary"))


def hex_long(digits: Column, start: int, length: int) -> Column:
    """``length`` (up to 15) hexadecimal digits from ``start`` (from 1) as a long."""
    return F.conv(F.substring(digits, start, length), 16, 10).cast("long")


def uniform(seed: object, *keys: Column) -> Column:
    """A double in [0, 1)."""
    return hex_long(digest(seed, *keys), 1, 8) / F.lit(4294967296.0)


def below(n: Column | int, seed: object, *keys: Column) -> Column:
    """A long from 0 to n - 1."""
    return hex_long(digest(seed, *keys), 1, 12) % n


def dna(length: int, seed: object, *keys: Column) -> Column:
    """A sequence of uniform bases; four hexadecimal digits stand for each base."""
    parts = [F.translate(digest(f"{seed}" if not k else f"{seed}+{k}", *keys), _HEX, BASES * 4) for k in range(-(-length // 32))]
    return F.substring(F.concat(*parts), 1, length)


def bits(length: int, seed: object, *keys: Column) -> Column:
    """A long of ``length`` fair bits (up to 60)."""
    if not 0 < length <= 60:
        raise ValueError("codes of 1 to 60 bits fit a long")
    drawn = hex_long(digest(seed, *keys), 1, -(-length // 4))
    return F.shiftright(drawn, -length % 4)
