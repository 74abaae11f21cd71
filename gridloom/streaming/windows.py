"""Streams of reads: decoding against a fixed library into a table, and rates by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decode import decode
from ..sources.tables import stored

DECODED = "read_id long, ts timestamp, decoded long, dist int, batch long"


def decode_stream(reads: DataFrame, library: DataFrame, threshold: int, length: int | None, output: str, checkpoint: str, late: str = "10 minutes", ties: str = "erase") -> None:
    """Decodes what is new of a stream (read_id, ts, seq) into a Parquet table at ``output`` (see DECODED), and ends.

    Repeats of a read go within the watermark. Each batch meets the library as reads at rest
    do, by its pieces, whatever the library's size, and writes a partition of its own
    (``batch=N``): a batch that is repeated after a failure replaces it by the same rows.
    """
    once = reads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["read_id"])

    def add(rows: DataFrame, number: int) -> None:
        made = stored(rows.select("read_id", "ts", "seq"), "reads")  # met twice: by their sequences, and whole
        done = decode(made, library, threshold, length, ties).select(F.col("read_id").cast("long").alias("read_id"), "ts", F.col("decoded").cast("long").alias("decoded"), "dist", F.lit(number).cast("long").alias("batch"))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output)

    query = once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def window_rates(outcomes: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, outcome, n, total) of rows (ts, outcome, value) by tumbling windows, at rest or streaming."""
    rows = outcomes.withWatermark("ts", late) if outcomes.isStreaming else outcomes
    out = rows.groupBy(F.window("ts", length).alias("w"), "outcome").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "outcome", "n", "total")
