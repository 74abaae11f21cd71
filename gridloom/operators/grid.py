"""Grids as rows (row, col): coordinates, blocks, neighbours, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 4


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """All (row, col) of a grid."""
    if rows <= 0 or cols <= 0:
        raise ValueError("a grid has at least one row and one column")
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))


def with_blocks(spots: DataFrame, cols: Column | int, block: int = BLOCK) -> DataFrame:
    """block_row, block_col and spot_in_block; spots outside a ragged edge do not count."""
    cols = F.lit(cols) if isinstance(cols, int) else cols
    b = F.lit(block)
    col0 = F.floor(F.col("col") / b) * b
    width = F.least(b, cols - col0)
    return spots.withColumns(
        {
            "block_row": F.floor(F.col("row") / b).cast("int"),
            "block_col": F.floor(F.col("col") / b).cast("int"),
            "spot_in_block": ((F.col("row") % b) * width + F.col("col") % b).cast("int"),
        }
    )


def block_columns(cols: int, block: int = BLOCK) -> int:
    return -(-cols // block)


def neighbours(spots: DataFrame, value: str) -> DataFrame:
    """(row, col, direction, a, b): each spot's value with its right and its bottom neighbour's."""
    return at_steps(spots, value, (1,)).drop("step")


def far_neighbours(spots: DataFrame, value: str, low: int = 5, high: int = 14) -> DataFrame:
    """(row, col, direction, step, a, b): values low to high steps apart along rows and columns."""
    return at_steps(spots, value, range(low, high + 1))


def at_steps(spots: DataFrame, value: str, steps: Sequence[int]) -> DataFrame:
    """(row, col, direction, step, a, b): values so many steps apart along rows and columns, by one equi-join on the shifted place.

    Both sides are shuffled: every spot's value is needed, so neither is a table to broadcast, whatever its file's size.
    """
    ways = F.array(*(F.struct(F.lit(d).alias("direction"), F.lit(k).alias("step")) for d in ("right", "bottom") for k in steps))
    left = spots.select("row", "col", F.col(value).alias("a"), F.explode(ways).alias("w")).select("row", "col", "a", "w.direction", "w.step")
    down = F.col("direction") == "bottom"
    moved = left.withColumns({"row2": F.col("row") + F.when(down, F.col("step")).otherwise(0), "col2": F.col("col") + F.when(down, 0).otherwise(F.col("step"))})
    other = spots.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col(value).alias("b"))
    return moved.join(other.hint("shuffle_hash"), ["row2", "col2"]).select("row", "col", "direction", "step", "a", "b")


def coverage(spots: DataFrame, rows: int, cols: int) -> DataFrame:
    """(issue, row, col): missing places of the grid, extra places outside it, and duplicates."""
    seen = spots.groupBy("row", "col").agg(F.count("*").alias("n"))
    full = grid(spots.sparkSession, rows, cols)
    missing = full.join(seen, ["row", "col"], "left_anti").select(F.lit("missing").alias("issue"), "row", "col")
    outside = (F.col("row") < 0) | (F.col("row") >= rows) | (F.col("col") < 0) | (F.col("col") >= cols)
    extra = seen.where(outside).select(F.lit("extra").alias("issue"), "row", "col")
    twice = seen.where("n > 1").select(F.lit("duplicate").alias("issue"), "row", "col")
    return missing.union(extra).union(twice)


def duplicates(df: DataFrame, key: str, keep: str | bool = False) -> DataFrame:
    """Rows whose key occurs more than once: all of them (keep=False), or all but the first by row and col ('first')."""
    w = Window.partitionBy(key)
    if keep == "first":
        return df.withColumn("__n", F.row_number().over(w.orderBy("row", "col"))).where("__n > 1").drop("__n")
    return df.withColumn("__n", F.count("*").over(w)).where("__n > 1").drop("__n")
