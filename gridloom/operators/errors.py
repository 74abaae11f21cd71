"""Error models: sequences to noisy reads, by keyed random numbers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.prng import hex_long

# Eight hexadecimal digits of a place's digest make a number in [0, 1).
_WHOLE = 16**8
MOST_BASES = 200  # of a sequence whose draws are made in numpy
AT_ONCE = 8192


def _places(seq: Column, seed: object, key: Column, make) -> Column:
    """``make(base, digest)`` at each place, joined; an empty sequence stays."""
    step = lambda k: make(F.substr(seq, k, F.lit(1)), _digest(seed, key, k))
    joined = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1))), step), "")
    return F.when(F.length(seq) == 0, "").otherwise(joined)


def _digest(seed: object, key: Column, k: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), k.cast("string")).cast("binary"))


def _other(base: Column, d: Column) -> Column:
    """One of the other three bases."""
    at = F.translate(base, "ACGT", "0123").cast("int") + 1 + (hex_long(d, 9, 4) % 3).cast("int")
    return F.substr(F.lit("ACGTACG"), at + 1, F.lit(1))


def _below(d: Column, start: int, rate: float) -> Column:
    """Whether the number that eight digits make is below the rate: digits of one length compare as numbers do."""
    most = math.ceil(rate * _WHOLE)
    return F.lit(True) if most >= _WHOLE else F.substring(d, start, 8) < F.lit(f"{most:08x}")


def _substitution_in_numpy(rate: float, seed: str):
    """Reads of ``substitution``; null for what is left to expressions."""

    def read(seqs: pd.Series, keys: pd.Series) -> pd.Series:
        out = np.full(len(seqs), None, object)
        codes = np.full(256, 4, np.uint8)
        codes[list(b"ACGT")] = range(4)
        bases = np.frombuffer(b"ACGTACG", np.uint8)
        for part, text, key in _bytes_of(seqs, keys, seed):
            text, drawn = text.copy(), draws.Draws(seed, key)
            plain = (codes[text] < 4).all(axis=1)
            for k in range(1, text.shape[1] + 1):
                u, w = drawn.at(k)
                hit = np.flatnonzero((u < _rate(rate)) & plain)
                text[hit, k - 1] = bases[codes[text[hit, k - 1]] + 1 + (w[hit] >> np.uint32(16)) % np.uint32(3)]
            out[part[plain]] = text.view(f"S{text.shape[1]}")[plain, 0].astype(str)
        return pd.Series(out, dtype=object)

    return read


def substitution(seq: Column, key: Column, rate: float, seed: object = 0) -> Column:
    """Each base becomes, with the rate, one of the other three; many reads at once."""
    quick = F.pandas_udf(_substitution_in_numpy(rate, str(seed)), "string")
    return F.coalesce(quick(seq, key.cast("string")), substitution_by_place(seq, key, rate, seed))


def substitution_by_place(seq: Column, key: Column, rate: float, seed: object = 0) -> Column:
    return _places(seq, seed, key, lambda b, d: F.when(_below(d, 1, rate), _other(b, d)).otherwise(b))


def indel(seq: Column, key: Column, sub: float, ins: float, dele: float, seed: object = 0) -> Column:
    """Each base is lost, or else perhaps substituted and perhaps followed by a new base."""

    def make(b: Column, d: Column) -> Column:
        kept = F.when(_below(d, 1, sub), _other(b, d)).otherwise(b)
        new = F.when(_below(d, 13, ins), F.substr(F.lit("ACGT"), (hex_long(d, 21, 4) % 4).cast("int") + 1, F.lit(1))).otherwise("")
        return F.when(_below(d, 25, dele), "").otherwise(F.concat(kept, new))

    return _places(seq, seed, key, make)


def _bytes_of(seqs: pd.Series, keys: pd.Series, seed: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows by lengths, AT_ONCE at most, with their bases and keys as bytes; only rows of letters that numpy can take."""
    fit = seqs.notna() & keys.notna()
    fit &= seqs.where(fit, "").map(lambda s: s.isascii() and 0 < len(s) <= MOST_BASES) & keys.where(fit, "").map(lambda k: k.isascii() and "\0" not in k and draws.fits(seed, len(k), 2 * MOST_BASES))
    size = seqs.where(fit, "").str.len().to_numpy()
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        for at in range(0, len(rows), AT_ONCE):
            part = rows[at : at + AT_ONCE]
            text = np.array(seqs.iloc[part].to_list(), dtype=f"S{n}").view(np.uint8).reshape(len(part), n)
            yield part, text, np.array(keys.iloc[part].to_list(), dtype="S")


def _rate(rate: float) -> np.uint64:
    return np.uint64(min(_WHOLE, math.ceil(rate * _WHOLE)))


def _fixed_length_in_numpy(sub: float, ins: float, dele: float, seed: str):
    """Reads of ``fixed_length``; null for what is left to expressions."""

    def read(seqs: pd.Series, keys: pd.Series) -> pd.Series:
        out = np.full(len(seqs), None, object)
        for part, text, key in _bytes_of(seqs, keys, f"{seed}s"):
            (m, n), rows = text.shape, np.arange(len(part))
            bases = np.frombuffer(b"ACGT", np.uint8)
            base = lambda w: bases[(w >> np.uint32(8) & np.uint32(255)) % 4]
            place = lambda w, size: (w >> np.uint32(16)).astype(np.int64) % size
            text, gone = text.copy(), np.zeros((m, n), bool)
            edits, losses, gains, more = (draws.Draws(f"{seed}{kind}", key) for kind in "sdip")
            for k in range(1, n + 1):
                u, w = edits.at(k)
                hit = np.flatnonzero(u < _rate(min(1.0, sub * 4 / 3)))
                text[hit, place(w[hit], n)] = base(w[hit])
                u, w = losses.at(k)
                hit = np.flatnonzero(u < _rate(dele))
                gone[hit, place(w[hit], n)] = True
            grown = np.zeros((m, 2 * n), np.uint8)
            left = ~gone
            grown[np.nonzero(left)[0], (np.cumsum(left, axis=1) - 1)[left]] = text[left]
            kept = left.sum(axis=1)
            size = kept.copy()
            for k in range(1, int(kept.max(initial=0)) + 1):
                u, w = gains.at(k)
                hit = np.flatnonzero((u < _rate(ins)) & (k <= kept))
                at = place(w[hit], size[hit] + 1)
                order = np.arange(2 * n)[None, :] - (np.arange(2 * n)[None, :] > at[:, None])
                moved = np.take_along_axis(grown[hit], order, axis=1)
                moved[np.arange(len(hit)), at] = base(w[hit])
                grown[hit] = moved
                size[hit] += 1
            for k in range(1, int((n - size).max(initial=0)) + 1):
                hit = rows[n - size >= k]
                grown[hit, size[hit] + k - 1] = base(more.at(k, hit)[1])
            out[part] = np.ascontiguousarray(grown[:, :n]).view(f"S{n}")[:, 0].astype(str)
        return pd.Series(out, dtype=object)

    return read


def fixed_length(seq: Column, key: Column, sub: float, ins: float, dele: float, seed: object = 0) -> Column:
    """A read of the same length by edits of the whole sequence (see ``fixed_length_by_place``), many reads at once."""
    quick = F.pandas_udf(_fixed_length_in_numpy(sub, ins, dele, str(seed)), "string")
    return F.coalesce(quick(seq, key.cast("string")), fixed_length_by_place(seq, key, sub, ins, dele, seed))


def fixed_length_by_place(seq: Column, key: Column, sub: float, ins: float, dele: float, seed: object = 0) -> Column:
    """A read of the same length by edits of the whole sequence, one kind after another.

    Each of its places draws once for each kind, so the numbers of edits are binomial:
    substitutions (any of four bases, at 4/3 of the rate) at places drawn with
    replacement, in turn; deletions at such places, a place once; then, for each base
    left, perhaps a new one, each put in anywhere after those before it. Random bases
    fill up, or what is too long goes.
    """
    n = F.length(seq)
    drawn = lambda kind, most: F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: _digest(f"{seed}{kind}", key, k))
    base = lambda d: F.substr(F.lit("ACGT"), (hex_long(d, 13, 2) % 4).cast("int") + 1, F.lit(1))
    place = lambda d, size: (hex_long(d, 9, 4) % size).cast("int")

    def put(s: Column, d: Column) -> Column:
        at = place(d, n)
        return F.when(_below(d, 1, min(1.0, sub * 4 / 3)), F.concat(F.left(s, at), base(d), F.substr(s, at + 2, n))).otherwise(s)

    def push(s: Column, d: Column) -> Column:
        at = place(d, F.length(s) + 1)
        return F.when(_below(d, 1, ins), F.concat(F.left(s, at), base(d), F.substr(s, at + 1, F.length(s)))).otherwise(s)

    changed = F.aggregate(drawn("s", n), seq, put)
    gone = F.transform(F.filter(drawn("d", n), lambda d: _below(d, 1, dele)), lambda d: place(d, n) + 1)
    left_over = lambda c, g: F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: ~F.array_contains(g, k)), lambda k: F.substr(c, k, F.lit(1))), "")
    kept = _let(F.struct(changed.alias("c"), gone.alias("g")), lambda x: left_over(x["c"], x["g"]))
    grown = _let(kept, lambda k: F.when(F.length(k) == 0, "").otherwise(F.aggregate(drawn("i", F.length(k)), k, push)))
    # No more bases are drawn than fill up.
    filled = _let(grown, lambda g: F.when(F.length(g) >= n, F.left(g, n)).otherwise(F.concat(g, F.array_join(F.transform(drawn("p", n - F.length(g)), base), ""))))
    return F.when(n == 0, "").otherwise(filled)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


@dataclass(frozen=True)
class ErrorModel:
    """A channel by name: a column of reads, the SQL that gives the same reads, and its rates.

    ``column(seq, key, seed=..., **rates)`` is an expression; ``sql(seq, key, seed=..., **rates)``
    a DuckDB expression of the same text.
    """

    rates: tuple[str, ...]
    column: Callable[..., Column]
    sql: Callable[..., str]

    def checked(self, rates: dict[str, float]) -> dict[str, float]:
        if set(rates) != set(self.rates) or not all(0 <= r <= 1 for r in rates.values()):
            raise ValueError(f"rates from 0 to 1 are needed for {', '.join(self.rates)}, not {rates}")
        return rates


MODELS: dict[str, ErrorModel] = {}


def register(name: str, rates: tuple[str, ...], column: Callable[..., Column], sql: Callable[..., str]) -> None:
    """Adds a channel, for commands and queries alike."""
    if name in MODELS:
        raise ValueError(f"there is an error model {name}")
    MODELS[name] = ErrorModel(rates, column, sql)


def read_of(model: str, seq: Column, key: Column, seed: object = 0, **rates: float) -> Column:
    """``seq`` through the channel of a name; an unknown name or rate is an error."""
    if model not in MODELS:
        raise ValueError(f"unknown error model: {model}; there are {', '.join(MODELS)}")
    found = MODELS[model]
    return found.column(seq, key, seed=seed, **found.checked(rates))


def read_sql(model: str, seq: str, key: str, seed: object = 0, **rates: float) -> str:
    """DuckDB SQL of :func:`read_of`."""
    found = MODELS[model]
    return found.sql(seq, key, seed=seed, **found.checked(rates))


def _u_sql(digest_: str, start: int) -> str:
    return f"('0x' || substr({digest_}, {start}, 8))::BIGINT / 4294967296.0"


def _other_sql(base: str, digest_: str) -> str:
    return f"substr('ACGTACG', (translate({base}, 'ACGT', '0123')::INT + 2 + (('0x' || substr({digest_}, 9, 4))::BIGINT % 3))::INT, 1)"


def substitution_sql(seq: str, key: str, rate: float, seed: object = 0) -> str:
    d, b = f"md5('{seed}:' || {key} || ':' || k)", f"substr({seq}, k::INT, 1)"
    return f"array_to_string(list_transform(range(1, length({seq}) + 1), lambda k: CASE WHEN {_u_sql(d, 1)} < {rate} THEN {_other_sql(b, d)} ELSE {b} END), '')"


def indel_sql(seq: str, key: str, sub: float, ins: float, dele: float, seed: object = 0) -> str:
    d, b = f"md5('{seed}:' || {key} || ':' || k)", f"substr({seq}, k::INT, 1)"
    kept = f"CASE WHEN {_u_sql(d, 1)} < {sub} THEN {_other_sql(b, d)} ELSE {b} END"
    new = f"CASE WHEN {_u_sql(d, 13)} < {ins} THEN substr('ACGT', ((('0x' || substr({d}, 21, 4))::BIGINT % 4) + 1)::INT, 1) ELSE '' END"
    return f"array_to_string(list_transform(range(1, length({seq}) + 1), lambda k: CASE WHEN {_u_sql(d, 25)} < {dele} THEN '' ELSE {kept} || {new} END), '')"


def fixed_length_sql(seq: str, key: str, sub: float, ins: float, dele: float, seed: object = 0) -> str:
    """One expression: steps take what the one before made from a list of one."""
    let = lambda value, name, use: f"list_transform([{value}], lambda {name}: {use})[1]"
    digests = lambda kind, n: f"list_transform(range(1, {n} + 1), lambda k: md5('{seed}{kind}:' || {key} || ':' || k))"
    at = lambda e, n: f"(('0x' || substr({e}, 9, 4))::BIGINT % ({n}))::INT"
    base = lambda e: f"substr('ACGT', (('0x' || substr({e}, 13, 2))::BIGINT % 4)::INT + 1, 1)"
    size = f"length({seq})"
    changed = f"list_reduce(list_prepend({seq}, {digests('s', size)}), lambda s, e: CASE WHEN {_u_sql('e', 1)} < {min(1.0, sub * 4 / 3)} THEN left(s, {at('e', 'length(s)')}) || {base('e')} || substr(s, {at('e', 'length(s)')} + 2) ELSE s END)"
    gone = f"list_transform(list_filter({digests('d', size)}, lambda e: {_u_sql('e', 1)} < {dele}), lambda e: {at('e', size)} + 1)"
    kept = "array_to_string(list_transform(list_filter(range(1, length(x.c) + 1), lambda k: NOT list_contains(x.g, k::INT)), lambda k: substr(x.c, k::INT, 1)), '')"
    kept = let(f"struct_pack(c := {changed}, g := {gone})", "x", kept)
    grown = f"list_reduce(list_prepend(w, {digests('i', 'length(w)')}), lambda s, e: CASE WHEN {_u_sql('e', 1)} < {ins} THEN left(s, {at('e', 'length(s) + 1')}) || {base('e')} || substr(s, {at('e', 'length(s) + 1')} + 1) ELSE s END)"
    fill = f"array_to_string(list_transform({digests('p', size)}, lambda e: {base('e')}), '')"
    return f"left({let(kept, 'w', grown)} || {fill}, {size}::INT)"


register("substitution", ("rate",), substitution, substitution_sql)
register("indel", ("sub", "ins", "dele"), indel, indel_sql)
register("fixed_length", ("sub", "ins", "dele"), fixed_length, fixed_length_sql)
