"""A growing sample sheet: every new sample gets a barcode that it keeps.

Samples are the rows of ``documents``: the text says what a sample is, the source is
the plate it lies on. The barcode follows from the text alone: drawn from its digest,
the first of some attempts that passes the rules for barcodes, else the first one
repaired. So equal texts share a barcode, on whatever day they come, and no barcode
given out ever changes. The sample that had a text first owns its barcode, the others
are its copies.

The job is incremental: a file stream with a checkpoint takes only files that are
new. Each of its batches writes partitions of its own (``batch=N/plate=P``) and looks
only at those of batches before it, so a batch that is repeated after a failure writes
the same rows in the same place. A sample that is delivered again is known by its id
and changes nothing.

Cases: a null text is empty; a null or empty source is the plate ``none``; rows
without an id cannot be told apart later and are left out (the log says how many); of
rows that share an id the one with the smallest digest, then plate, counts. Other
columns do not matter. The order of batches decides owners, nothing else does.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import dna, prng
from gridloom.operators import qc

from .shared import as_it_stands, command

SCHEMA = "doc_id long, sign string, owner long, copy boolean, barcode string, attempt int, gc double, g double, run int, batch long, plate string"
log = logging.getLogger("jobs.sample_barcodes")


@dataclass(frozen=True)
class Settings:
    length: int = 28
    attempts: int = 8
    gc: tuple[float, float] = (0.4, 0.6)
    g_max: float = 0.25
    run_max: int = 3
    seed: str = "sample"
    files_per_batch: int | None = None  # all at once, if not given


def barcode(sign: Column, s: Settings) -> Column:
    """Struct (barcode, attempt): the first attempt that passes the rules; else the first one with G and runs reduced, as attempt -1."""
    drawn = [prng.dna(s.length, f"{s.seed}{k}", sign) for k in range(s.attempts)]
    made = lambda seq, k: F.struct(seq.alias("barcode"), F.lit(k).alias("attempt"))
    repaired = dna.break_runs(dna.reduce_g(drawn[0], s.g_max)["seq"], s.run_max)["seq"]
    return F.coalesce(*(F.when(qc.spot_candidate(seq, tuple(s.gc), s.g_max, s.run_max), made(seq, k)) for k, seq in enumerate(drawn)), made(repaired, -1))


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: Settings = Settings()) -> None:
    """Adds the samples of new files below DOCUMENTS to the sheet at OUTPUT."""
    columns = ["doc_id", "text", "source"]
    stream = spark.readStream.schema(spark.read.parquet(documents).select(*columns).schema)
    if settings.files_per_batch:
        stream = stream.option("maxFilesPerTrigger", settings.files_per_batch)
    started = (
        stream.parquet(_files(documents)).writeStream.foreachBatch(lambda rows, number: _add(rows, number, output, settings))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    started.awaitTermination()
    progress = [p for p in started.recentProgress if p["numInputRows"]]
    log.info("read %d rows of %s in %d batches", sum(p["numInputRows"] for p in progress), documents, len(progress))


def _files(path: str) -> str:
    """``path`` as a pattern of one name, by which a file stream takes a single file as well as a folder."""
    top, slash, name = path.rstrip("/").rpartition("/")
    return path if any(c in name for c in "*?[{") else f"{top}{slash}{{{name}}}"


def _add(rows: DataFrame, number: int, output: str, s: Settings) -> None:
    """Batch ``number`` of the stream: its samples that the sheet does not have yet."""
    known = as_it_stands(rows.sparkSession, output, SCHEMA).where(F.col("batch") < number)
    plate = F.when(F.col("source") != "", F.col("source")).otherwise("none")
    signed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("sign"), plate.alias("plate")).persist()
    try:
        n = signed.agg(F.count("*").alias("rows"), F.count("doc_id").alias("with_id")).first()
        fresh = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("sign", "plate")).alias("m")).select("doc_id", "m.sign", "m.plate")
        fresh = fresh.join(known.select("doc_id"), "doc_id", "left_anti")
        # One row a text, the owners of earlier batches first: counted before the shuffle, so a text of many copies is no burden.
        owners = known.select("sign", F.lit(0).alias("now"), F.col("owner")).unionByName(fresh.select("sign", F.lit(1).alias("now"), F.col("doc_id").alias("owner")))
        owners = owners.groupBy("sign").agg(F.min(F.struct("now", "owner")).alias("first"), F.max("now").alias("now")).where("now = 1").select("sign", "first.owner", F.col("first.now").alias("is_new"))
        coded = owners.withColumn("made", barcode(F.col("sign"), s)).select("sign", "owner", "is_new", "made.barcode", "made.attempt")
        measured = coded.withColumns({"gc": F.round(dna.gc_fraction(F.col("barcode")), 6), "g": F.round(dna.g_fraction(F.col("barcode")), 6), "run": dna.max_run(F.col("barcode"))})
        out = fresh.join(measured, "sign").withColumns({"copy": F.col("doc_id") != F.col("owner"), "batch": F.lit(number).cast("long")})
        out = out.select("doc_id", "sign", "owner", "copy", "barcode", "attempt", "gc", "g", "run", "batch", "plate")
        _write(out, output, number, n)
    finally:
        signed.unpersist()


def _write(out: DataFrame, output: str, number: int, n: Row) -> None:
    """Partitions of the batch, large plates in several files; the log tells what then stands there."""
    out.hint("rebalance", "plate").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "plate").parquet(output)
    there = as_it_stands(out.sparkSession, output, SCHEMA).where(F.col("batch") == number)
    wrote = there.agg(F.count("*").alias("rows"), F.count_if(~F.col("copy")).alias("owners"), F.count_if(F.col("attempt") < 0).alias("repaired")).first()
    log.info(
        "batch %d: read %d rows (%d without an id), wrote %d samples to %s, %d of them with a barcode of their own (%d repaired)",
        number, n["rows"], n["rows"] - n["with_id"], wrote["rows"], output, wrote["owners"], wrote["repaired"],
    )


def main(args: list[str] | None = None) -> None:
    command("sample_barcodes", Settings, {"documents": "folder of Parquet files", "output": "folder of the sheet", "checkpoint": "folder of the stream's checkpoint"}, run, args)


if __name__ == "__main__":
    main()
