"""Spot counts of a sequencing run, lane by lane.

Reads of each lane are decoded against the array's library (nearest sequence within
a number of edits) and counted on the spots of the array: how many reads a spot has,
how many without an error, their mean distance. Reads that no spot gets are a row
without a place. Beside the spots, each lane has a row of rates: decoded, erased, and, as the origin of the reads is known here, right and
wrong ones.

The library is a table of keys (``p_partkey``; spot key // cols, key % cols), the
reads a table of keys and lanes (``o_orderkey``, ``o_orderstatus``). Where these tables
have a column ``seq``, it holds the sequences; otherwise sequences are drawn by key, and
reads are drawn from the library and go through the substitution channel, as in a
simulation of the run.

Output: ``spots`` and ``lanes``, both partitioned by lane. Lanes asked for (all, if none is
named) replace their own partitions, whole, and leave the others; a lane written twice
is the same as once. A lane that is asked for and has no reads is an error, and
so is a repeated key of the library. Reads without a key or lane are left out.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import prng
from gridloom.operators import decode, errors
from gridloom.operators.grid import with_blocks
from gridloom.operators.layouts import small
from gridloom.sources.tables import spread, stored

from .shared import as_it_stands, command

SPOTS = "row int, col int, n_reads long, n_exact long, n_right long, mean_distance double, block_row int, lane string"
LANES = "n_reads long, n_correct long, n_wrong long, n_erased long, n_decoded long, precision double, recall double, erasure_rate double, lane string"
log = logging.getLogger("jobs.lane_counts")


@dataclass(frozen=True)
class Settings:
    length: int = 28
    cols: int = 50
    threshold: int = 4
    ties: str = "erase"
    rate: float = 0.05
    seed: str = "read"
    library_seed: str = "lib"


def library_of(parts: DataFrame, s: Settings) -> DataFrame:
    """(idx, seq) of the array's spots."""
    seq = F.col("seq") if "seq" in parts.columns else prng.dna(s.length, s.library_seed, F.col("p_partkey"))
    return spread(parts.select("p_partkey", *(["seq"] if "seq" in parts.columns else []))).select(F.col("p_partkey").cast("long").alias("idx"), seq.alias("seq")).where("idx is not null")


def reads_of(orders: DataFrame, library: DataFrame, size: int, s: Settings) -> DataFrame:
    """(key, lane, truth, seq) of reads; truth is null where it is not known."""
    rows = orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("lane"), *(["seq"] if "seq" in orders.columns else [])).where("key is not null and lane <> ''")
    if "seq" in rows.columns:
        return rows.select("key", "lane", F.lit(None).cast("long").alias("truth"), "seq")
    drawn = spread(rows).withColumn("truth", F.col("key") * 7919 % size)
    clean = drawn.join(small(library.select(F.col("idx").alias("truth"), F.col("seq").alias("ref"))), "truth")
    return clean.select("key", "lane", "truth", errors.substitution(F.col("ref"), F.col("key"), s.rate, s.seed).alias("seq"))


def run(spark: SparkSession, library: str, reads: str, output: str, settings: Settings = Settings(), lanes: str | None = None) -> None:
    """Decodes the reads of READS against LIBRARY, both Parquet, and writes counts of spots and rates of lanes below OUTPUT."""
    s = settings
    array = library_of(spark.read.parquet(library), s)
    size = array.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("keys")).first()
    if size["n"] != size["keys"]:
        raise ValueError(f"{library}: {size['n'] - size['keys']} repeated keys")
    orders = spark.read.parquet(reads)
    if lanes:
        wanted = sorted(set(lanes.split(",")))
        orders = orders.where(F.col("o_orderstatus").isin(wanted))
    made = stored(reads_of(orders, array, size["n"], s), "reads")  # met twice: by their sequences, and whole
    # Decoded once for both outputs.
    done = stored(decode.decode(made, array, s.threshold, s.length, s.ties).select("lane", "truth", "decoded", "dist"), "decoded")
    if lanes:
        missing = set(wanted) - {r["lane"] for r in done.select("lane").distinct().collect()}
        if missing:
            raise ValueError(f"{reads}: no reads of lanes {sorted(missing)}")
    log.info("read %d reads of %s and a library of %d spots of %s", done.count(), reads, size["n"], library)
    place = {"row": F.expr(f"cast(decoded div {s.cols} as int)"), "col": (F.col("decoded") % s.cols).cast("int")}
    counts = done.groupBy("lane", "decoded").agg(
        F.count("*").alias("n_reads"), F.count_if(F.col("dist") == 0).alias("n_exact"), F.count_if(F.col("truth") == F.col("decoded")).alias("n_right"), F.round(F.avg("dist"), 6).alias("mean_distance")
    )
    spots = with_blocks(counts.withColumns(place), s.cols).select("row", "col", "n_reads", "n_exact", "n_right", "mean_distance", "block_row", "lane")
    _write(spots, f"{output}/spots", SPOTS)
    _write(decode.benchmark_rates(done, "lane"), f"{output}/lanes", LANES)


def _write(rows: DataFrame, path: str, schema: str) -> None:
    """The partitions of the lanes in ``rows``, whole; the log tells what then stands there."""
    rows.hint("rebalance", "lane").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lane").parquet(path)
    there = as_it_stands(rows.sparkSession, path, schema).groupBy("lane").count().orderBy("lane").collect()  # a row a lane
    log.info("wrote %s: %s", path, ", ".join(f"{r['count']} rows of lane {r['lane']}" for r in there) or "no rows")


def main(args: list[str] | None = None) -> None:
    command(
        "lane_counts", Settings, {"library": "Parquet file or folder", "reads": "Parquet file or folder", "output": "folder of the counts"}, run, args,
        lanes={"help": "lanes to decode, with commas; all, if not given"},
    )


if __name__ == "__main__":
    main()
