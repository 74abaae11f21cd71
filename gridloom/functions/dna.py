"""Column builders on DNA sequences and bit codes; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default mappings and motifs.
TWO_BIT = {"00": "A", "01": "C", "10": "G", "11": "T"}
ONE_BIT = {"0": "A", "1": "T"}
ONE_HOT = {"1000": "A", "0100": "C", "0010": "G", "0001": "T"}
MOTIFS = ("GGGG", "CCCC", "AAAAAA", "TTTTTT", "GCGCGC", "CGCGCG")
_RUN = r"(.)\1*"


def share_of(seq: Column, letters: str) -> Column:
    """Share of the given bases, either case; 0.0 for an empty sequence."""
    kept = F.length(seq) - F.length(F.translate(F.upper(seq), letters, ""))
    return F.coalesce(F.try_divide(kept.cast("double"), F.length(seq)), F.when(seq.isNotNull(), 0.0))


def gc_fraction(seq: Column) -> Column:
    return share_of(seq, "GC")


def g_fraction(seq: Column) -> Column:
    return share_of(seq, "G")


def run_strings(seq: Column) -> Column:
    """The maximal runs of equal bases, in order."""
    return F.regexp_extract_all(F.upper(seq), F.lit(_RUN), 0)


def max_run(seq: Column) -> Column:
    """Length of the longest run; 0 for an empty sequence."""
    return F.coalesce(F.array_max(F.transform(run_strings(seq), F.length)), F.when(seq.isNotNull(), 0))


def longest_run(seq: Column) -> Column:
    """Struct (length, base) of the longest run, the earliest of equal ones; (0, '') for an empty sequence."""
    start = F.struct(F.lit(0).alias("length"), F.lit("").alias("base"))
    return F.aggregate(
        run_strings(seq), start, lambda best, r: F.when(F.length(r) > best["length"], F.struct(F.length(r).alias("length"), F.left(r, F.lit(1)).alias("base"))).otherwise(best)
    )


def runs(seq: Column, least: int = 1) -> Column:
    """Array of (base, length, start, end) of runs of ``least`` or more; end is inclusive."""
    kind = "array<struct<base:string,length:int,start:int,end:int>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(state: Column, r: Column) -> Column:
        n = F.length(r)
        run = F.struct(F.left(r, F.lit(1)).alias("base"), n.alias("length"), state["at"].alias("start"), (state["at"] + n - 1).alias("end"))
        return F.struct((state["at"] + n).alias("at"), F.concat(state["out"], F.array(run)).alias("out"))

    found = F.aggregate(run_strings(seq), empty, add, lambda s: s["out"])
    return F.filter(found, lambda r: r["length"] >= least)


def motif_positions(seq: Column, motif: str) -> Column:
    """0-based places of a motif, overlapping ones included."""
    n = len(motif)
    last = F.length(seq) - n
    # Places are gone through only where the motif occurs, which most sequences do not have.
    places = F.when(F.contains(F.upper(seq), F.lit(motif)), F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substr(F.upper(seq), i + 1, F.lit(n)) == motif)


def motif_hits(seq: Column, motifs: tuple[str, ...] = MOTIFS) -> Column:
    """Array of (motif, positions, count) of the motifs that occur."""
    one = lambda m: F.struct(F.lit(m).alias("motif"), motif_positions(seq, m).alias("positions"), F.size(motif_positions(seq, m)).alias("count"))
    return F.filter(F.array(*map(one, motifs)), lambda h: h["count"] > 0)


def bit_string(code: Column, length: int) -> Column:
    """A long as ``length`` binary digits."""
    return F.lpad(F.bin(code), length, "0")


def check_mapping(mapping: dict[str, str]) -> int:
    """Input bits for each base; an error unless all words of one length, or four one-hot words, map to distinct bases."""
    sizes = {len(k) for k in mapping}
    bases = list(mapping.values())
    if len(sizes) != 1 or any(set(k) - set("01") for k in mapping) or len(set(bases)) != len(bases) or set(bases) - set("ACGT"):
        raise ValueError(f"not a mapping of bits to bases: {mapping}")
    (n,) = sizes
    if n == 4 and all(k.count("1") == 1 for k in mapping) and len(mapping) == 4:
        return 2
    if len(mapping) != 2**n:
        raise ValueError(f"a mapping of {n} bits needs {2**n} words")
    return n


def dna_length(bits: int, mapping: dict[str, str] = TWO_BIT) -> int:
    """Bases that so many bits make; an error if they do not fill the last one."""
    n = check_mapping(mapping)
    if bits % n:
        raise ValueError(f"{bits} bits are not a multiple of {n}")
    return bits // n


def bits_of_dna(length: int, mapping: dict[str, str] = TWO_BIT) -> int:
    """Bits that so many bases hold, the inverse of ``dna_length``."""
    return length * check_mapping(mapping)


def _words(mapping: dict[str, str]) -> dict[str, str]:
    """The mapping by the bits that are read: a one-hot base is named by two bits, its place."""
    if check_mapping(mapping) == 2 and len(next(iter(mapping))) == 4:
        return {format(k.index("1"), "02b"): v for k, v in mapping.items()}
    return mapping


def bits_to_dna(bits: Column, mapping: dict[str, str] = TWO_BIT) -> Column:
    """A bit string as DNA; a length that does not fit is an error."""
    words = _words(mapping)
    n = len(next(iter(words)))
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    steps = F.sequence(F.lit(1), F.greatest(F.length(bits), F.lit(1)), F.lit(n))
    out = F.array_join(F.transform(steps, lambda i: F.element_at(table, F.substr(bits, i, F.lit(n)))), "")
    bad = F.concat(F.lit(f"bits are not a multiple of {n}: "), F.length(bits).cast("string"))
    return F.when(F.length(bits) == 0, "").when(F.length(bits) % n != 0, F.raise_error(bad)).otherwise(out)


def dna_to_bits(seq: Column, mapping: dict[str, str] = TWO_BIT) -> Column:
    """DNA as a bit string, the inverse; an unknown base is an error."""
    back = {v: k for k, v in _words(mapping).items()}
    table = F.create_map(*(F.lit(x) for pair in back.items() for x in pair))
    bad = F.concat(F.lit("unknown base in "), seq)
    out = F.array_join(F.transform(F.split(F.upper(seq), ""), lambda b: F.element_at(table, b)), "")
    return F.when(F.length(seq) == 0, "").when(F.upper(seq).rlike(f"[^{''.join(back)}]"), F.raise_error(bad)).otherwise(out)


def hamming_bits(a: Column, b: Column) -> Column:
    """Differing bits of two codes held as longs."""
    return F.bit_count(a.bitwiseXOR(b))


def packed(seq: Column) -> Column:
    """A sequence of 31 bases A, C, G, T or fewer as a long, two bits a base; null for others."""
    plain = (F.length(seq) <= 31) & (F.translate(seq, "ACGT", "") == "")
    return F.when(plain & (seq == ""), F.lit(0).cast("long")).when(plain, F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("long"))


def hamming_packed(a: Column, b: Column) -> Column:
    """Differing bases of two packed sequences of one length."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x1555555555555555)))


def hamming(a: Column, b: Column, policy: str = "strict", packed_a: Column | None = None, packed_b: Column | None = None) -> Column:
    """Differing places. Unequal lengths: an error ('strict'), the common part ('truncate') or null ('inf').

    Short plain sequences are compared as packed longs; joins pass those in, made once a row.
    """
    if policy not in ("strict", "truncate", "inf"):
        raise ValueError(f"unknown policy: {policy}")
    n = F.least(F.length(a), F.length(b))
    count = F.aggregate(
        F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x
    )
    quick = hamming_packed(packed(a) if packed_a is None else packed_a, packed(b) if packed_b is None else packed_b)
    count = F.coalesce(F.when(F.length(a) == F.length(b), quick), F.when(n == 0, 0).otherwise(count))
    if policy == "truncate":
        return count
    other = F.raise_error(F.lit("sequences differ in length")).cast("int") if policy == "strict" else F.lit(None).cast("int")
    return F.when(F.length(a) == F.length(b), count).when(a.isNotNull() & b.isNotNull(), other)


def levenshtein_capped(a: Column, b: Column, cap: int) -> Column:
    """Edit distance if it is at most ``cap``, else cap + 1."""
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, cap + 1).otherwise(d)


def reduce_g(seq: Column, share: float = 0.25) -> Column:
    """Struct (seq, swaps): of the G's beyond floor(share * length), the last become T."""
    most = F.floor(F.length(seq) * F.lit(share)).cast("int")
    swaps = F.greatest(F.length(seq) - F.length(F.translate(seq, "G", "")) - most, F.lit(0))
    head = F.call_function("substring_index", seq, F.lit("G"), most + 1)  # up to the first G too many
    tail = F.substr(seq, F.length(head) + 1, F.length(seq))
    return F.struct(F.concat(head, F.translate(tail, "G", "T")).alias("seq"), F.when(seq.isNotNull(), swaps).alias("swaps"))


def break_runs(seq: Column, most: int = 3) -> Column:
    """Struct (seq, subs): within runs longer than ``most`` every (most + 1)-th base is replaced, A and T by C, C and G by A."""
    # New bases are small letters until the end, so that they are no part of a run.
    first = F.regexp_replace(F.upper(seq), rf"([AT])\1{{{most}}}", "$1" * most + "c")
    both = F.regexp_replace(first, rf"([^ATc])\1{{{most}}}", "$1" * most + "a")
    subs = F.length(both) - F.length(F.translate(both, "ac", ""))
    return F.struct(F.upper(both).alias("seq"), subs.alias("subs"))


def feature_id(row: Column, col: Column, cols: int, style: str = "row_col") -> Column:
    """R###_C###, or the running number for style 'linear'; another style is as 'row_col'."""
    return (row * cols + col).cast("string") if style == "linear" else F.format_string("R%03d_C%03d", row, col)


def target_distance(diff: Column, distances: tuple[int, ...] = (2, 4, 6, 8), far: int = 8) -> Column:
    """Target for codes ``diff`` positions apart: 0, then the list, then ``far``."""
    out = F.when(diff == 0, 0)
    for k, d in enumerate(distances, 1):
        out = out.when(diff == k, d)
    return out.otherwise(far)


def chebyshev(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.greatest(F.abs(r1 - r2), F.abs(c1 - c2))


def bit_length_for(n: int, far: int, bits_per_base: int = 2) -> int:
    """Bits that n positions need: max(4, ceil(log2 n)) + far // 2, rounded up to whole bases."""
    need = max(4, (n - 1).bit_length() if n > 1 else 0) + far // 2
    return -(-need // bits_per_base) * bits_per_base
