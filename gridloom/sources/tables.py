"""Tables that a job stores for itself in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that is unset, in a local session, a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a cut lineage that lost executors do not touch."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows_a_task: int = 2_000, *by: str, n: int | None = None) -> DataFrame:
    """``df`` (of ``n`` rows, if known) dealt over tasks by number of rows, or by columns: for a narrow table with much work a row, which Spark reads in one task.

    A file's bytes say nothing of that work, and a row group is not split. Up to four tasks a core.
    """
    n = df.count() if n is None else n
    tasks = min(4 * df.sparkSession.sparkContext.defaultParallelism, -(-n // rows_a_task))
    return df.repartition(tasks, *by) if tasks > 1 else df


def numbered(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """``df`` with the place of each row in an order, from 0, without one task that sees all rows.

    Rows are sorted by ranges and stored; their number within a range plus the rows of
    the ranges before gives the place. The ranges' counts are a row each, and broadcast.
    Rows that the order leaves equal have any of their places.
    """
    rows = stored(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    return with_places(rows, F.shiftright("__at", 33).alias("__part"), name=name)


def with_places(rows: DataFrame, *parts: Column, name: str) -> DataFrame:
    """``rows`` (a running number ``__at``, without gaps within a part) with their place: parts by their columns, then by ``__at``."""
    keys = [f"__k{i}" for i in range(len(parts))]
    rows = rows.select("*", *(p.alias(k) for p, k in zip(parts, keys)))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, (before - F.col("__first")).alias("__offset"))  # a row for each part: partitions or splits of files
    return rows.join(F.broadcast(offsets), keys).withColumn(name, F.col("__at") + F.col("__offset")).drop("__at", "__offset", *keys)
