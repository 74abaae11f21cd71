"""Connected components of links held in tables, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) longs -> (node, component), the smallest node that each can reach.

    Large-star and small-star steps by turns until nothing changes; every step is
    grouped minima and joins, so that a node of many links is pre-aggregated. Nodes
    without links, and links with a null end, do not occur in the result. More than
    ``rounds`` turns is an error, never a cut result (a turn about squares the reach).
    """
    spark = edges.sparkSession
    now = written(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "edges")
        was, mark = mark, _mark(new)
        remove(spark, now)
        now = new
        if mark == was:
            break
    else:
        raise RuntimeError("components: links have not settled")
    # Settled: every edge leads from a node to its component's smallest node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """A count and a sum that tell whether the edges have changed."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
