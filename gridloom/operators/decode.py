"""Decoding reads: nearest library sequence within a threshold, with a rule for ties; outcomes and rates."""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..sources.tables import spread, stored
from . import blocks
from .layouts import small

A_KEY = 2  # making and looking up a key, in pairs compared
A_LOOK = 0.4  # looking up a key in a task's own table, in pairs compared there
MOST_LENGTHS = 8  # lengths of a library that are met by pieces, each by a join
GOOD_PART = 0.25  # share of its reads that a radius settles, for the next one to be larger by one only


def brute_matches(reads: DataFrame, library: DataFrame, threshold: int, metric: str = "levenshtein") -> DataFrame:
    """(seq, idx, dist) of all (distinct read sequence, library entry) within the threshold.

    Every pair is compared: for libraries or sequences too short for segments. The
    library is broadcast only if it is small.
    """
    refs = library.select("idx", F.col("seq").alias("ref"))
    seqs = reads.select("seq").distinct()
    if metric == "levenshtein":
        dist = F.levenshtein(F.col("seq"), F.col("ref"), threshold)
        near = F.abs(F.length("seq") - F.length("ref")) <= threshold
        return seqs.join(small(refs), near & (dist >= 0)).select("seq", "idx", dist.alias("dist"))
    if metric == "hamming":
        dist = dna.hamming(F.col("seq"), F.col("ref"), "inf", F.col("__s"), F.col("__r"))
        met = seqs.withColumn("__s", dna.packed(F.col("seq"))).join(small(refs.withColumn("__r", dna.packed(F.col("ref")))), (F.length("seq") == F.length("ref")) & (dist <= threshold))
        return met.select("seq", "idx", dist.alias("dist"))
    raise ValueError(f"unknown metric: {metric}")


def segment_matches(reads: DataFrame, library: DataFrame, threshold: int, length: int, metric: str = "levenshtein", whole: int = 1) -> DataFrame:
    """As ``brute_matches``, for a library of sequences of one length.

    A sequence cut into threshold + whole pieces has ``whole`` of them that at most
    ``threshold`` edits leave as they are. A key is such a choice of pieces; reads look
    theirs up in the table of the library's keys, a hash join. Under the Hamming distance
    pieces stay in their places. Otherwise ``_moves`` bounds how far they go. The distance
    is tested at the join, and only pairs within the threshold are shuffled, to be made
    distinct. Exact for any ``whole``: with more, keys are longer, so that a read meets
    fewer entries of a large library, but has more keys (see ``pieces_for``).
    """
    if length < threshold + whole:
        raise ValueError("more pieces than bases: use brute_matches")
    cuts = [length * k // (threshold + whole) for k in range(threshold + whole + 1)]
    chosen = list(combinations(range(threshold + whole), whole))
    packed = [dna.packed(F.col("seq"))] if metric == "hamming" else []
    # A piece at a place is hashed once a sequence, whatever the number of keys it is in.
    piece = lambda k, move: F.xxhash64(F.substring("seq", cuts[k] + 1 + move, cuts[k + 1] - cuts[k])).alias(f"__{k}_{move}")
    key = lambda n, ks, ms: F.xxhash64(F.lit(n), *(F.col(f"__{k}_{m}") for k, m in zip(ks, ms)))
    hashed = lambda rows, wanted: rows.select("*", F.length("seq").alias("__n"), *(piece(k, m) for k, m in sorted({x for _, ks, ms in wanted for x in zip(ks, ms)})))
    plain = [(n, ks, (0,) * whole) for n, ks in enumerate(chosen)]
    refs = hashed(library.select("idx", "seq"), plain).select("idx", F.col("seq").alias("ref"), *(p.alias("__r") for p in packed), F.explode(F.array(*(key(*w) for w in plain))).alias("key"))
    if metric == "levenshtein":
        more = F.col("__n") - length
        wanted = [(n, ks, ms) for n, ks in enumerate(chosen) for ms in _moves(ks, cuts)]
        # A read that is longer moves its end, by the pieces that follow and are not chosen.
        fits = lambda ks, ms: (F.abs(more - ms[-1]) <= threshold - (ks[-1] - whole + 1)) & (F.col("__n") >= cuts[ks[-1] + 1] + ms[-1])
        windows = [F.when(fits(ks, ms), key(n, ks, ms)) for n, ks, ms in wanted]
    else:
        wanted, windows = plain, [key(*w) for w in plain]
    most = threshold if metric == "levenshtein" else 0
    seqs = reads.select("seq").distinct().where(F.length("seq").between(length - most, length + most))
    seen = hashed(seqs, wanted).select("seq", *(p.alias("__s") for p in packed), F.explode(F.array(*windows)).alias("key")).where("key is not null")
    met = seen.join(small(refs), "key")
    if metric == "hamming":
        # Sequences that are not packed, with letters beside the bases, are compared place by place.
        dist = dna.hamming(F.col("seq"), F.col("ref"), "inf", F.col("__s"), F.col("__r"))
        return met.withColumn("dist", dist).where(F.col("dist") <= threshold).select("seq", "idx", "dist").distinct()
    return met.withColumn("dist", F.levenshtein("seq", "ref", threshold)).where("dist >= 0").select("seq", "idx", "dist").distinct()


def _moves(pieces: tuple[int, ...], cuts: list[int]) -> list[tuple[int, ...]]:
    """Places, relative to their own, at which a read may hold these pieces of a sequence, unedited.

    Let S(k) be the pieces before k less the edits before k: it gains one at most with a
    piece, and ends at ``whole`` or more. The last k with S(k) = j, for j from 0 to whole - 1,
    is a piece without edits; these are the pieces chosen. So as many edits lie before the
    first as pieces, and between two as pieces between them; after the last there are no
    more than pieces that follow, if the edits are ``threshold`` or fewer.
    """
    out = [(m,) for m in range(-pieces[0], pieces[0] + 1) if cuts[pieces[0]] + m >= 0]
    for before, k in zip(pieces, pieces[1:]):
        out = [(*ms, ms[-1] + d) for ms in out for d in range(before + 1 - k, k - before) if cuts[k] + ms[-1] + d >= 0]
    return out


def pieces_for(size: int, threshold: int, length: int, metric: str = "levenshtein") -> int:
    """``whole`` of ``segment_matches`` for a library of ``size``: the one with least work a read, looking up a key being that of some pairs."""
    return _least_work(size, threshold, length, metric)[1]


def _least_work(size: int, threshold: int, length: int, metric: str, a_key: float = A_KEY, wholes: tuple[int, ...] = (1, 2, 3)) -> tuple[float, int]:
    """The work a read of ``pieces_for``, in pairs compared, and that ``whole``."""

    def work(whole: int) -> float:
        cuts = [length * k // (threshold + whole) for k in range(threshold + whole + 1)]
        total = 0.0
        for ks in combinations(range(threshold + whole), whole):
            keys = 1 if metric == "hamming" else sum(abs(ms[-1]) <= threshold - (ks[-1] - whole + 1) for ms in _moves(ks, cuts))
            total += keys * (a_key + size / 4 ** sum(cuts[k + 1] - cuts[k] for k in ks))
        return total

    return min((work(w), w) for w in wholes if length >= 2 * (threshold + w) or w == 1)


def near_matches(reads: DataFrame, library: DataFrame, sizes: dict[int, int], threshold: int, metric: str = "levenshtein") -> DataFrame:
    """``brute_matches`` of a library with ``sizes``, entries by length: by pieces, each of the most frequent lengths for itself, where that is less work than comparing all."""
    pieces = _by_pieces(sizes, threshold, metric)
    full = [n for n in sizes if n not in pieces]
    of = lambda lengths: library if len(sizes) == 1 else library.where(F.length("seq").isin(lengths))
    found = [segment_matches(reads, of([n]), threshold, n, metric, pieces_for(sizes[n], threshold, n, metric)) for n in pieces]
    if full or not pieces:
        found.append(brute_matches(reads, of(full), threshold, metric))
    return reduce(DataFrame.unionByName, found)


def _by_pieces(sizes: dict[int, int], threshold: int, metric: str) -> list[int]:
    """The lengths that are met by pieces, each for itself."""
    pieces: list[int] = []
    for length in sorted(sizes, key=lambda n: (-sizes[n], n)):
        few = length <= threshold or len(pieces) == MOST_LENGTHS or _least_work(sizes[length], threshold, length, metric)[0] >= sizes[length]
        if not few:
            pieces.append(length)
    return pieces


def nearest(matches: DataFrame) -> DataFrame:
    """(seq, dist, n, idx): the least distance, how many entries have it, the smallest of them."""
    by_dist = matches.groupBy("seq", "dist").agg(F.count("*").alias("n"), F.min("idx").alias("idx"))
    return by_dist.groupBy("seq").agg(F.min(F.struct("dist", "n", "idx")).alias("b")).select("seq", "b.dist", "b.n", "b.idx")


def nearest_by_pieces(reads: DataFrame, library: DataFrame, threshold: int, length: int | None = None, metric: str = "levenshtein") -> DataFrame:
    """``nearest`` of ``near_matches``; the library has sequences of ``length``, or of any lengths, which are counted.

    Keys are looked up block by block (``blocks.nearest_in_blocks``), so that they are no rows.
    What is not made of the four bases, or is long, is met by joins.
    """
    lengths = library.where("seq is not null").groupBy(F.length("seq").alias("n")).agg(F.count("*").alias("size"), F.count_if(_plain("seq")).alias("plain")).collect()  # a row for each length
    sizes = {r["n"]: r["size"] for r in lengths if length is None or r["n"] == length}
    in_words = {r["n"] for r in lengths if r["size"] == r["plain"] and r["n"] + threshold <= blocks.MOST_BASES}
    pieces = [n for n in _by_pieces(sizes, threshold, metric) if n in in_words]
    if not pieces:
        return _nearest_by_joins(reads, library, sizes, threshold, metric)
    seqs = stored(reads.select("seq").where("seq is not null").distinct().withColumn("plain", _plain("seq")), "reads")
    there = {r["plain"]: r["count"] for r in seqs.groupBy("plain").count().collect()}  # two rows
    plain, keys = seqs.where("plain").select("seq"), lambda n: partial(_keys, threshold=threshold, length=n, metric=metric)
    of = lambda ns: library.where(F.length("seq").isin(ns))
    found = [blocks.nearest_in_blocks(plain, there.get(True, 0), of([n]), sizes[n], threshold, n, metric, keys(n)) for n in pieces]
    others = {n: k for n, k in sizes.items() if n not in pieces}
    if others:
        found.append(_nearest_by_joins(plain, of(list(others)), others, threshold, metric))
    out = reduce(DataFrame.unionByName, found)
    if len(found) > 1:
        by_dist = out.groupBy("seq", "dist").agg(F.sum("n").alias("n"), F.min("idx").alias("idx"))
        out = by_dist.groupBy("seq").agg(F.min(F.struct("dist", "n", "idx")).alias("b")).select("seq", "b.dist", "b.n", "b.idx")
    if there.get(False):
        out = out.unionByName(_nearest_by_joins(seqs.where("not plain"), library, sizes, threshold, metric))
    return out


def _plain(seq: str) -> Column:
    return (F.translate(seq, "ACGT", "") == "") & (F.length(seq) <= blocks.MOST_BASES)


def _keys(size: int, radius: int, bases: int, threshold: int, length: int, metric: str) -> blocks.Keys:
    """The keys of ``blocks.nearest_in_blocks``: those of ``segment_matches`` for reads of so many bases, with least work where looking up a key is little beside comparing a pair."""
    if length <= radius:
        raise ValueError("more pieces than bases: use brute_matches")
    whole = _least_work(size, radius, length, metric, A_LOOK if metric == "levenshtein" else 1.0, (1, 2, 3, 4))[1]
    cuts = [length * k // (radius + whole) for k in range(radius + whole + 1)]
    more, out = bases - length, []
    for ks in combinations(range(radius + whole), whole):
        moves = [(0,) * whole]
        if metric == "levenshtein":
            moves = [ms for ms in _moves(ks, cuts) if abs(more - ms[-1]) <= radius - (ks[-1] - whole + 1) and all(cuts[k + 1] + m <= bases for k, m in zip(ks, ms))]
        if moves:
            out.append((cuts, ks, moves))
    return out


def _nearest_by_joins(reads: DataFrame, library: DataFrame, sizes: dict[int, int], threshold: int, metric: str) -> DataFrame:
    """``nearest`` of ``near_matches``.

    Edit distances are looked for within a small radius first, where pieces are long and
    few; a read that has an entry there has all of its nearest there, and only the others
    are looked up within the next one. The radius grows by one as long as it settles a
    good part of its reads; if it does not, most are far from all, and the threshold is next.
    """
    look = lambda rows, t: nearest(near_matches(rows, library, sizes, t, metric))
    if metric != "levenshtein" or threshold < 2 or not _by_pieces(sizes, threshold, metric):
        return look(reads, threshold)
    rest, radius, settled = stored(reads.select("seq").where("seq is not null").distinct(), "rest"), 1, []
    left = rest.count()
    while radius < threshold and left:
        settled.append(stored(look(spread(rest, 2_000, "seq", n=left), radius), "nearest"))
        rest = stored(rest.join(settled[-1].hint("shuffle_hash"), "seq", "left_anti"), "rest")
        before, left = left, rest.count()
        radius = radius + 1 if before - left >= GOOD_PART * before else threshold
    if left or not settled:
        settled.append(look(spread(rest, 2_000, "seq", n=left), threshold))
    return reduce(DataFrame.unionByName, settled)


def decode(reads: DataFrame, library: DataFrame, threshold: int, length: int | None = None, ties: str = "erase", metric: str = "levenshtein") -> DataFrame:
    """``reads`` with decoded (library idx or null), dist and ambiguous.

    Ties: 'erase' leaves the read undecoded, 'first' takes the smallest idx and marks it.
    All entries of the library may have one ``length``; otherwise their lengths are counted.
    """
    if ties not in ("erase", "first"):
        raise ValueError(f"unknown rule for ties: {ties}")
    best = nearest_by_pieces(reads, library, threshold, length, metric)
    decoded = F.when(F.col("n") == 1, F.col("idx")) if ties == "erase" else F.col("idx")
    best = best.select("seq", decoded.alias("decoded"), "dist", (F.col("n") > 1).alias("ambiguous"))
    return reads.join(best, "seq", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def decode_hierarchical(reads: DataFrame, bar1: DataFrame, bar2: DataFrame, split_at: int, t1: int, t2: int) -> DataFrame:
    """``reads`` with decoded_1 and decoded_2: both parts of a read decoded by themselves; erased unless both are."""
    parts = reads.withColumns({"part_1": F.substring("seq", 1, split_at), "part_2": F.expr(f"substring(seq, {split_at + 1})")})
    one = decode(parts.select(F.col("part_1").alias("seq")).distinct(), bar1, t1, split_at).select(F.col("seq").alias("part_1"), F.col("decoded").alias("d1"))
    two = decode(parts.select(F.col("part_2").alias("seq")).distinct(), bar2, t2).select(F.col("seq").alias("part_2"), F.col("decoded").alias("d2"))
    both = F.col("d1").isNotNull() & F.col("d2").isNotNull()
    out = parts.join(one, "part_1", "left").join(two, "part_2", "left")
    return out.withColumns({"decoded_1": F.when(both, F.col("d1")), "decoded_2": F.when(both, F.col("d2"))}).drop("d1", "d2", "part_1", "part_2")


def split_read(seq: Column, spacer: str, x_length: int, y_length: int) -> Column:
    """Struct (x, y): the two sides of a spacer that occurs once, else the first and last bases of a read long enough; null otherwise.

    An empty spacer always splits by places.
    """
    by_place = F.when(F.length(seq) >= x_length + y_length, F.struct(F.left(seq, F.lit(x_length)).alias("x"), F.right(seq, F.lit(y_length)).alias("y")))
    if not spacer:
        return by_place
    sides = F.split(seq, f"\\Q{spacer}\\E", -1)
    return F.when(F.size(sides) == 2, F.struct(sides[0].alias("x"), sides[1].alias("y"))).otherwise(by_place)


def decode_components(reads: DataFrame, x_axis: DataFrame, y_axis: DataFrame, spacer: str, x_length: int, y_length: int, threshold: int, metric: str = "hamming") -> DataFrame:
    """``reads`` with decoded_row, decoded_col, x_distance, y_distance, ambiguous and success: both axes by themselves, ties to the smallest position."""
    cut = reads.withColumn("__s", split_read(F.col("seq"), spacer, x_length, y_length)).withColumns({"__x": F.col("__s.x"), "__y": F.col("__s.y")}).drop("__s")

    def axis(name: str, table: DataFrame, length: int) -> DataFrame:
        parts = cut.where(f"__{name} is not null").select(F.col(f"__{name}").alias("seq")).distinct()
        found = decode(parts, table.select(F.col("pos").alias("idx"), "seq"), threshold, length, ties="first", metric=metric)
        return found.select(F.col("seq").alias(f"__{name}"), F.col("decoded").alias(f"__{name}_pos"), F.col("dist").alias(f"__{name}_dist"), F.col("ambiguous").alias(f"__{name}_amb"))

    out = cut.join(axis("x", x_axis, x_length), "__x", "left").join(axis("y", y_axis, y_length), "__y", "left")
    ok = F.col("__x_pos").isNotNull() & F.col("__y_pos").isNotNull()
    return out.withColumns(
        {
            "success": ok,
            "decoded_row": F.when(ok, F.col("__y_pos")),
            "decoded_col": F.when(ok, F.col("__x_pos")),
            "x_distance": F.when(ok, F.col("__x_dist")),
            "y_distance": F.when(ok, F.col("__y_dist")),
            "ambiguous": ok & (F.col("__x_amb") | F.col("__y_amb")),
        }
    ).drop(*(f"__{a}{s}" for a in "xy" for s in ("", "_pos", "_dist", "_amb")))


def classify(decoded: DataFrame, near: int = 2) -> DataFrame:
    """``outcome`` and ``spatial_distance`` of reads with true_row, true_col and a component decode."""
    far = dna.chebyshev(F.col("true_row"), F.col("true_col"), F.col("decoded_row"), F.col("decoded_col"))
    exact = (F.col("true_row") == F.col("decoded_row")) & (F.col("true_col") == F.col("decoded_col"))
    outcome = F.when(~F.col("success"), "failed").when(F.col("ambiguous"), "ambiguous").when(exact, "correct").when(far <= near, "near_error").otherwise("far_error")
    return decoded.withColumns({"outcome": outcome, "spatial_distance": F.when(F.col("success"), far)})


def simulation_summary(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of outcomes; distances over the reads that decoded."""
    names = ("correct", "near_error", "far_error", "ambiguous", "failed")
    counts = [F.count_if(F.col("outcome") == n).alias(f"n_{n}") for n in names]
    rates = [F.round(F.avg((F.col("outcome") == n).cast("double")), 6).alias(f"{n}_rate") for n in names]
    total = F.col("x_distance") + F.col("y_distance")
    return outcomes.groupBy(*by).agg(F.count("*").alias("n_reads"), *counts, *rates, F.round(F.avg(total), 6).alias("mean_distance"), F.max(total).alias("max_distance"))


def rate_columns(truth: str = "truth", decoded: str = "decoded") -> list[Column]:
    """Aggregates: reads, correct, wrong, erased, decoded, and precision, recall and erasure rate (0 on an empty base)."""
    t, d = F.col(truth), F.col(decoded)
    n, right, done = F.count("*"), F.count_if(t == d), F.count(d)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    return [
        n.alias("n_reads"), right.alias("n_correct"), (done - right).alias("n_wrong"), (n - done).alias("n_erased"), done.alias("n_decoded"),
        share(right, done).alias("precision"), share(done, n).alias("recall"), share(n - done, n).alias("erasure_rate"),
    ]


def benchmark_rates(decoded: DataFrame, *by: str) -> DataFrame:
    return decoded.groupBy(*by).agg(*rate_columns())


def truth_index(reads: DataFrame, library: DataFrame) -> DataFrame:
    """``reads`` (true_seq) with truth, the first library index of that sequence, or -1."""
    first = library.groupBy(F.col("seq").alias("true_seq")).agg(F.min("idx").alias("truth"))
    return reads.join(first, "true_seq", "left").withColumn("truth", F.coalesce("truth", F.lit(-1)))
