"""Quadtree codes: a base for each level of subdivision, runs limited by permutations and forced changes."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

PERMUTATIONS = tuple(permutations(range(4)))  # in lexicographic order
BASES = "ACGT"


def least_levels(rows: int, cols: int) -> int:
    """ceil(log2) of the longer side."""
    return (max(rows, cols, 1) - 1).bit_length()


def with_uv(spots: DataFrame, rows: int, cols: int, levels: int) -> DataFrame:
    """u and v: the place scaled to a square of 2 ** levels."""
    return spots.withColumns({"u": F.expr(f"(cast(row as bigint) << {levels}) div {rows}"), "v": F.expr(f"(cast(col as bigint) << {levels}) div {cols}")})


def quadrant(level: int, levels: int) -> Column:
    """0 to 3: the quarter at a level, from the coarsest."""
    s = levels - 1 - level
    return (F.shiftright("u", s) % 2 * 2 + F.shiftright("v", s) % 2).cast("int")


def contingency(state: DataFrame, quarter: Column, max_run: int, *by: str) -> DataFrame:
    """(q, prev, n, at_risk): at most 16 rows (for each value of ``by``), whatever the grid."""
    return state.groupBy(*by, quarter.alias("q"), "prev").agg(F.count("*").alias("n"), F.sum((F.col("run_len") >= max_run).cast("long")).alias("at_risk"))


def best_permutation(table: list[tuple[int, int, int, int]]) -> tuple[tuple[int, ...], int, int]:
    """(permutation, violations, repeats): fewest forced changes, then fewest repeats, then the first."""
    n = {(q, p): k for q, p, k, _ in table}
    risk = {(q, p): r for q, p, _, r in table}
    scored = [(sum(risk.get((q, p[q]), 0) for q in range(4)), sum(n.get((q, p[q]), 0) for q in range(4)), p) for p in PERMUTATIONS]
    violations, repeats, chosen = min(scored)
    return chosen, violations, repeats


def quadtree_codes(spots: DataFrame, rows: int, cols: int, levels: int, max_run: int = 1, start: tuple[int, ...] = (0, 1, 2, 3), keep_every: int = 4) -> tuple[DataFrame, list[dict]]:
    """(row, col, seq of ``levels`` bases) and, for each level, permutation, forced changes and repeats."""
    codes, report = rounds_of_codes(spots, rows, cols, levels, [start], max_run, keep_every)
    return codes.select("row", "col", F.col("seqs")[0].alias("seq")), report[0]


def rounds_of_codes(
    spots: DataFrame, rows: int, cols: int, levels: int, starts: list[tuple[int, ...]], max_run: int = 1, keep_every: int = 4
) -> tuple[DataFrame, list[list[dict]]]:
    """(row, col, seqs: a code for each start permutation) and each round's report by level.

    All rounds go through the levels together: their last bases and run lengths are arrays of
    a row, so a level costs one aggregate of at most 16 rows a round, whatever the grid, and
    no join. The state is stored now and then to cut its lineage.
    """
    if levels < 1 or max_run < 1 or not starts or any(sorted(start) != [0, 1, 2, 3] for start in starts):
        raise ValueError("levels and max_run are 1 or more, starts are permutations")
    pick = lambda p, q: F.element_at(F.array(*map(F.lit, p)), q + 1)
    letter = lambda b: F.element_at(F.array(*map(F.lit, BASES)), b + 1)
    state = with_uv(spots.select("row", "col"), rows, cols, levels)
    first = F.array(*(pick(start, quadrant(0, levels)) for start in starts))
    state = state.withColumn("rounds", F.transform(first, lambda b: F.struct(b.alias("prev"), F.lit(1).alias("run_len"), letter(b).alias("seq"))))
    report = [[{"level": 0, "permutation": start, "violations": 0, "repeats": 0}] for start in starts]
    for level in range(1, levels):
        q = quadrant(level, levels)
        each = state.select(q.alias("q"), F.posexplode("rounds").alias("round", "r")).select("q", "round", "r.prev", "r.run_len")
        tables: list[list[tuple[int, int, int, int]]] = [[] for _ in starts]
        for r in contingency(each, F.col("q"), max_run, "round").collect():  # 16 rows a round
            tables[r["round"]].append((r["q"], r["prev"], r["n"], r["at_risk"]))
        best = [best_permutation(table) for table in tables]
        for rows_, (chosen, violations, repeats) in zip(report, best):
            rows_.append({"level": level, "permutation": chosen, "violations": violations, "repeats": repeats})
        shift = (F.col("row") + F.col("col") + level) % 3 + 1

        def step(r: Column, cand: Column) -> Column:
            forced = (cand == r["prev"]) & (r["run_len"] >= max_run)
            base = F.when(forced, (r["prev"] + shift) % 4).otherwise(cand).cast("int")  # noqa: B023 (used at once)
            return F.struct(base.alias("prev"), F.when(base == r["prev"], r["run_len"] + 1).otherwise(1).alias("run_len"), F.concat(r["seq"], letter(base)).alias("seq"))

        state = state.withColumn("rounds", F.zip_with("rounds", F.array(*(pick(chosen, q) for chosen, _, _ in best)), step))
        if level % keep_every == 0:
            state = stored(state, "quadtree")
    return state.select("row", "col", F.transform("rounds", lambda r: r["seq"]).alias("seqs")), report


def round_starts(rounds: int) -> list[tuple[int, ...]]:
    """A start permutation for each round, different for up to 24 of them."""
    return [PERMUTATIONS[k * 7 % 24] for k in range(rounds)]


def repeated_rounds(spots: DataFrame, rows: int, cols: int, levels: int, rounds: int, max_run: int = 1) -> DataFrame:
    """row, col, quadtree_round1.. and quadtree_combined: codes of several rounds, each with a start permutation of its own."""
    return with_rounds(rounds_of_codes(spots, rows, cols, levels, round_starts(rounds), max_run)[0], rounds)


def with_rounds(codes: DataFrame, rounds: int) -> DataFrame:
    """The codes of :func:`rounds_of_codes` in columns of their own, and joined."""
    return codes.select("row", "col", *(F.col("seqs")[k].alias(f"quadtree_round{k + 1}") for k in range(rounds)), F.array_join("seqs", "").alias("quadtree_combined"))


def round_report(layout: DataFrame, rounds: int, least: int = 2) -> DataFrame:
    """A row for each round and one (round 0) for their combination: codes, different ones, their share, the mean and the most uses, codes used ``least`` times or more."""
    columns = ["quadtree_combined", *(f"quadtree_round{k + 1}" for k in range(rounds))]
    each = layout.select(F.posexplode(F.array(*columns)).alias("round", "code"))
    uses = each.groupBy("round", "code").agg(F.count("*").alias("uses"))
    return uses.groupBy("round").agg(
        F.sum("uses").alias("n"), F.count("*").alias("n_unique"), F.round(100.0 * F.count("*") / F.sum("uses"), 6).alias("unique_percent"),
        F.round(F.avg("uses"), 6).alias("reuse"), F.max("uses").alias("most_uses"), F.count_if(F.col("uses") >= least).alias("n_shared"),
    )


def uniqueness(layout: DataFrame, column: str) -> DataFrame:
    """n, n_unique, unique_percent and reuse of a column."""
    return layout.agg(
        F.count("*").alias("n"), F.countDistinct(column).alias("n_unique"), F.round(F.try_divide(100.0 * F.countDistinct(column), F.count("*")), 6).alias("unique_percent"),
        F.round(F.try_divide(F.count("*").cast("double"), F.countDistinct(column)), 6).alias("reuse"),
    )


def reuse_report(layout: DataFrame, column: str) -> DataFrame:
    """Codes by how often they occur: n_codes, and the first of the commonest, one row for each number of uses."""
    uses = layout.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("uses"))
    return uses.groupBy("uses").agg(F.count("*").alias("n_codes"), F.min("code").alias("first_code"))


def level_report(spark, report: list[dict]) -> DataFrame:
    """The report of :func:`quadtree_codes` as a table: level, permutation (as letters), violations, repeats."""
    rows = [(r["level"], "".join("ACGT"[b] for b in r["permutation"]), r["violations"], r["repeats"]) for r in report]
    return spark.createDataFrame(rows, "level int, permutation string, violations long, repeats long")
