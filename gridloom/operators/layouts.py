"""Codebooks and layouts: axis products, block barcodes, spot barcodes, tails, and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.prng import below, digest
from .grid import block_columns, with_blocks

MOST_BROADCAST = 32 << 20  # bytes of an axis or library that may be sent to all executors


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcasting if its values have at most MOST_BROADCAST bytes (counted), else for a shuffle.

    Left to itself, Spark would judge by the bytes of the file, a fraction of those of
    sequences that are made from its keys, and collect them on the driver.
    """
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= MOST_BROADCAST else df.hint("shuffle_hash")


def codebook(x: DataFrame, y: DataFrame, spacer: str = "", style: str = "row_col", cols: int = 0) -> DataFrame:
    """Features of axis tables (pos, bits, seq): y gives rows, x gives columns; the product of the axes is the result itself."""
    left = y.select(F.col("pos").alias("row"), F.col("bits").alias("y_bits"), F.col("seq").alias("y_seq"), F.format_string("R%03d", "pos").alias("__r"))
    right = x.select(F.col("pos").alias("col"), F.col("bits").alias("x_bits"), F.col("seq").alias("x_seq"), F.format_string("_C%03d", "pos").alias("__c"))
    # The parts of an id are formatted once a place, not once a feature.
    feature = dna.feature_id(F.col("row"), F.col("col"), cols, style) if style == "linear" else F.concat("__r", "__c")
    from .products import in_strips

    return in_strips(right, left).select(
        feature.alias("feature_id"), "row", "col", "x_bits", "y_bits", "x_seq", "y_seq",
        F.concat("x_seq", F.lit(spacer), "y_seq").alias("zip_seq"),
    )


def codebook_stats(book: DataFrame) -> DataFrame:
    return book.agg(
        F.count("*").alias("n_features"), F.countDistinct("row").alias("n_rows"), F.countDistinct("col").alias("n_cols"),
        F.countDistinct("zip_seq").alias("n_unique"), F.min(F.length("zip_seq")).alias("min_length"), F.max(F.length("zip_seq")).alias("max_length"),
        F.max(F.length("x_bits")).alias("x_bits"), F.max(F.length("y_bits")).alias("y_bits"),
    )


def product_stats(x: DataFrame, y: DataFrame, spacer: str = "") -> DataFrame:
    """``codebook_stats`` of the codebook of two axis tables, from the axes.

    Where the sequences of an axis have one length, two features have the same sequence
    only if both parts are the same, so different parts are counted instead of
    features. Otherwise the product is made.
    """
    def side(table: DataFrame, k: str) -> DataFrame:
        n = F.length("seq")
        return table.agg(
            F.count("*").alias(f"{k}n"), F.countDistinct("pos").alias(f"{k}places"), F.countDistinct("seq").alias(f"{k}seqs"),
            F.min(n).alias(f"{k}least"), F.max(n).alias(f"{k}most"), F.max(F.length("bits")).alias(f"{k}bits"),
        )

    both = side(x, "__x").crossJoin(side(y, "__y"))  # one row each
    seen = both.first()
    if seen["__xleast"] != seen["__xmost"] and seen["__yleast"] != seen["__ymost"]:
        return codebook_stats(codebook(x, y, spacer))
    n, there = F.col("__xn") * F.col("__yn"), (F.col("__xn") > 0) & (F.col("__yn") > 0)
    whole = lambda c: F.when(there, F.col(c)).otherwise(0)
    return both.select(
        n.alias("n_features"), whole("__yplaces").alias("n_rows"), whole("__xplaces").alias("n_cols"), (F.col("__xseqs") * F.col("__yseqs")).alias("n_unique"),
        (F.col("__xleast") + F.col("__yleast") + len(spacer)).alias("min_length"), (F.col("__xmost") + F.col("__ymost") + len(spacer)).alias("max_length"),
        F.when(there, F.col("__xbits")).alias("x_bits"), F.when(there, F.col("__ybits")).alias("y_bits"),
    )


def feature_at(book: DataFrame, row: int, col: int) -> DataFrame:
    """The feature of a place: no row outside the grid."""
    return book.where((F.col("row") == row) & (F.col("col") == col))


def shuffled(library: DataFrame, seed: object) -> DataFrame:
    """(idx, seq) with idx the place in a random order that depends on the seed and the sequence."""
    from ..sources.tables import numbered

    return numbered(library.select("seq", digest(seed, F.col("seq")).alias("__d")), "__d", "seq").select("idx", "seq")


def assign_bar1(blocks: DataFrame, library: DataFrame, n: int) -> DataFrame:
    """Block k (``block``, row-major) gets entry k mod n of the shuffled library: the least used, in shuffled order."""
    return blocks.withColumn("idx", F.col("block") % n).join(small(library.withColumnRenamed("seq", "bar_1")), "idx").drop("idx")


def assign_bar2(spots: DataFrame, library: DataFrame, n: int, seed: object) -> DataFrame:
    """Each spot of a bar_1 gets another bar_2: spot k of a bar_1, by block and spot, the k-th of the shuffled library (idx, seq) from a place that the bar_1 draws.

    ``spots`` has bar_1, block and spot_in_block; a bar_1 with more than ``n`` spots is an error.
    """
    rank = F.row_number().over(Window.partitionBy("bar_1").orderBy("block", "spot_in_block")) - 1
    wanted = spots.withColumn("rank", rank)
    at = F.when(F.col("rank") < n, (below(n, seed, F.col("bar_1")) + F.col("rank")) % n).otherwise(F.raise_error(F.lit("too few bar_2 for a bar_1")).cast("long"))
    return wanted.withColumn("idx", at).join(small(library.withColumnRenamed("seq", "bar_2")), "idx").drop("idx", "rank")


def dual_layout(spots: DataFrame, cols: int, bar1: DataFrame, n1: int, bar2: DataFrame, n2: int, seed: object) -> DataFrame:
    """row, col, block_row, block_col, spot_in_block, bar_1, bar_2, combined of a grid."""
    if n1 < 1 or n2 < 16:
        raise ValueError("a dual layout needs one bar_1 and sixteen bar_2 at least")
    placed = with_blocks(spots, cols).withColumn("block", F.col("block_row") * block_columns(cols) + F.col("block_col"))
    first = assign_bar1(placed, shuffled(bar1, seed), n1)
    out = assign_bar2(first, shuffled(bar2, seed), n2, seed)
    return out.select("row", "col", "block_row", "block_col", "spot_in_block", "bar_1", "bar_2", F.concat("bar_1", "bar_2").alias("combined"))


def hierarchical_layout(spots: DataFrame, cols: int, bar1: DataFrame, bar2: DataFrame, seed: object) -> DataFrame:
    """Block barcodes by place, and the sixteen spot barcodes permuted anew in each block.

    ``bar1`` has block_row, block_col, seq; ``bar2`` sixteen rows idx, seq.
    """
    placed = with_blocks(spots, cols)
    blocks = placed.select("block_row", "block_col").distinct()
    order = F.row_number().over(Window.partitionBy("block_row", "block_col").orderBy(digest(seed, F.col("block_row"), F.col("block_col"), F.col("idx")), "idx")) - 1
    turned = blocks.crossJoin(F.broadcast(bar2.select("idx", F.col("seq").alias("bar_2")))).withColumn("spot_in_block", order).drop("idx")
    first = placed.join(bar1.select("block_row", "block_col", F.col("seq").alias("bar_1")), ["block_row", "block_col"])
    return first.join(turned, ["block_row", "block_col", "spot_in_block"]).select(
        "row", "col", "block_row", "block_col", "spot_in_block", "bar_1", "bar_2", F.concat("bar_1", "bar_2").alias("combined")
    )


def layout_violations(layout: DataFrame) -> DataFrame:
    """(rule, key, n): combined sequences used twice, blocks of several bar_1, and spot barcodes used twice in a block."""
    block = F.concat_ws(",", "block_row", "block_col")
    twice = layout.groupBy(F.col("combined").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    mixed = layout.groupBy(block.alias("key")).agg(F.countDistinct("bar_1").alias("n")).where("n > 1")
    again = layout.groupBy(F.concat_ws(",", "block_row", "block_col", "bar_2").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), "key", "n")
    return rule(twice, "unique_combined").union(rule(mixed, "one_bar_1")).union(rule(again, "distinct_bar_2"))


def layout_usage(layout: DataFrame) -> DataFrame:
    """(kind, seq, n): spots of each bar_1 and bar_2."""
    return layout.select(F.explode(F.array(F.struct(F.lit("bar_1").alias("kind"), F.col("bar_1").alias("seq")), F.struct(F.lit("bar_2").alias("kind"), F.col("bar_2").alias("seq")))).alias("x")).groupBy(
        F.col("x.kind").alias("kind"), F.col("x.seq").alias("seq")
    ).agg(F.count("*").alias("n"))


def layout_stats(layout: DataFrame) -> DataFrame:
    """One row: spots, different barcodes, and measures of the combined ones.

    The layout is stored and each column's different values are counted by themselves: in
    one aggregate, Spark would hold all of them beside the buffers of every measure.
    """
    from ..sources.tables import stored

    rows = stored(layout.select("combined", "bar_1", "bar_2"), "layout")
    g, gc = dna.g_fraction(F.col("combined")), dna.gc_fraction(F.col("combined"))
    measures = rows.agg(
        F.count("*").alias("n_spots"), F.round(F.avg(g), 4).alias("g_mean"), F.round(F.max(g), 4).alias("g_max"), F.count_if(g > 0.25).alias("g_above"),
        F.round(F.avg(gc), 4).alias("gc_mean"), F.round(F.min(gc), 4).alias("gc_min"), F.round(F.max(gc), 4).alias("gc_max"),
        F.max(dna.max_run(F.col("combined"))).alias("max_run"),
    )
    for column, name in (("combined", "n_unique"), ("bar_1", "n_bar_1"), ("bar_2", "n_bar_2")):
        measures = measures.crossJoin(rows.select(column).distinct().agg(F.count(column).alias(name)))  # one row each
    return measures.select("n_spots", "n_unique", "n_bar_1", "n_bar_2", "g_mean", "g_max", "g_above", "gc_mean", "gc_min", "gc_max", "max_run")


def long_table(layout: DataFrame, *columns: str) -> DataFrame:
    """(row, col, kind, seq): a row for each spot and column, as plotting tools take them."""
    kinds = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("seq")) for c in columns or ("bar_1", "bar_2", "combined")))
    return layout.select("row", "col", F.explode(kinds).alias("k")).select("row", "col", "k.kind", "k.seq")


def dual_report(layout: DataFrame, n1: int, n2: int) -> DataFrame:
    """One row: size, blocks, different barcodes and how many there could be, and the spots that a bar_1 and a bar_2 serve at least and at most.

    ``n1`` and ``n2`` are the sizes of the libraries that the layout was made from.
    """
    size = layout.agg(
        (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count("*").alias("n_spots"), F.countDistinct("block_row", "block_col").alias("n_blocks"),
        F.countDistinct("combined").alias("n_unique"), F.max(F.length("combined")).alias("length"),
    )
    uses = layout_usage(layout).groupBy("kind").agg(F.count("*").alias("used"), F.min("n").alias("least"), F.max("n").alias("most"))
    of = lambda kind: uses.where(F.col("kind") == kind).select(*(F.col(c).alias(f"{kind}_{c}") for c in ("used", "least", "most")))
    out = size.crossJoin(of("bar_1")).crossJoin(of("bar_2"))  # one row each
    return out.withColumns({"n_possible": F.lit(n1).cast("long") * n2, "all_unique": F.col("n_unique") == F.col("n_spots")})


def hybrid_report(layout: DataFrame) -> DataFrame:
    """One row of a layout of quadtree codes and tails (quadtree_combined, tail, barcode): different codes, tails and barcodes, their reuse, and the distances of neighbouring codes, all of them."""
    from .distances import of_neighbours

    near = of_neighbours(layout, "quadtree_combined").withColumnRenamed("dist", "d").agg(F.count("*").alias("n_neighbours"), F.round(F.avg("d"), 6).alias("near_mean"), F.round(F.stddev_pop("d"), 6).alias("near_std"), F.min("d").alias("near_min"), F.max("d").alias("near_max"))
    counts = layout.agg(
        (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count("*").alias("n_spots"), F.countDistinct("barcode").alias("n_unique"), F.max(F.length("barcode")).alias("length"),
        F.countDistinct("quadtree_combined").alias("n_codes"), F.countDistinct("tail").alias("n_tails"), F.round(F.try_divide(F.count("*").cast("double"), F.countDistinct("tail")), 6).alias("tail_reuse"),
    )
    return counts.withColumn("all_unique", F.col("n_unique") == F.col("n_spots")).crossJoin(near)  # one row each


def g_by_cycle(seqs: DataFrame, column: str) -> DataFrame:
    """(cycle, n, g_share): share of G at each place, by exploding bases and counting before the shuffle."""
    bases = seqs.select(F.posexplode(F.split(column, "")).alias("cycle", "base"))
    return bases.groupBy("cycle").agg(F.count("*").alias("n"), F.round(F.avg((F.col("base") == "G").cast("double")), 6).alias("g_share"))


def hierarchical_report(layout: DataFrame) -> DataFrame:
    """Figures of a layout beyond its statistics: blocks, the least distance of two bar_2, cycles with more than a quarter of G."""
    from .distances import min_pairwise, pairs

    bars = layout.select("bar_2").distinct()
    least = min_pairwise(pairs(bars.withColumn("other", F.col("bar_2")), "bar_2", "other", by_place=False))
    cycles = g_by_cycle(layout, "combined").agg(F.count_if(F.col("g_share") > 0.25).alias("cycles_above"), F.max("g_share").alias("g_share_max"))
    size = layout.agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.countDistinct("block_row", "block_col").alias("n_blocks"), (F.countDistinct("bar_1") * F.countDistinct("bar_2")).alias("n_possible"))
    return size.crossJoin(least.withColumnRenamed("min_dist", "bar_2_min_dist")).crossJoin(cycles)  # one row each


def block_qc(blocks: DataFrame) -> DataFrame:
    """Figures of block barcodes (block_row, block_col, seq, g_swaps, run_subs): counts, G and GC, the longest run, distances of neighbours and of blocks 5 to 14 steps apart."""
    from .distances import of_neighbours

    g, gc, seq = dna.g_fraction(F.col("seq")), dna.gc_fraction(F.col("seq")), F.col("seq")
    counts = blocks.agg(
        F.count("*").alias("n"), F.countDistinct("seq").alias("n_unique"), F.count_if(F.col("g_swaps") > 0).alias("n_g_changed"), F.round(F.avg(g), 4).alias("g_mean"), F.round(F.max(g), 4).alias("g_max"),
        F.count_if(g > 0.25).alias("g_above"), F.round(F.avg(gc), 4).alias("gc_mean"), F.round(F.min(gc), 4).alias("gc_min"), F.round(F.max(gc), 4).alias("gc_max"), F.max(dna.max_run(seq)).alias("run_max"),
    )
    spots = blocks.select(F.col("block_row").alias("row"), F.col("block_col").alias("col"), "seq")
    of = {"adjacent": F.when(F.col("step") == 1, F.col("dist")), "far": F.when(F.col("step") > 1, F.col("dist"))}
    figures = [x for name, d in of.items() for x in (F.min(d).alias(f"{name}_min"), F.round(F.avg(d), 2).alias(f"{name}_mean"), F.max(d).alias(f"{name}_max"))]
    return counts.crossJoin(of_neighbours(spots, "seq", (1, *range(5, 15))).agg(*figures))  # one row each


def assign_tails(spots: DataFrame, library: DataFrame, n: int, index: Column, strategy: str = "sequential", seed: object = 42) -> DataFrame:
    """A library sequence for each spot, column ``tail``: by running index with wrap-around, or drawn with replacement ('random')."""
    if strategy in ("sequential", "spatial"):
        at = index % n
    elif strategy == "random":
        from ..functions.prng import below

        at = below(n, seed, index)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return spots.withColumn("idx", at).join(small(library.withColumnRenamed("seq", "tail")), "idx").drop("idx")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` in both tables."""
    return a.select(key).intersect(b.select(key))
