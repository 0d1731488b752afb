"""Streams of article lines into flat tables, and late-tolerant counts of arriving candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mentionloom.operators.tagged import flatten_records


def lines(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """(line_key, payload) of the text files that arrive in ``folder``; the key is the hash of the line, so a line delivered again has the same."""
    text = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)
    return text.filter(F.trim("value") != "").select(F.sha2("value", 256).alias("line_key"), F.col("value").alias("payload"))


def stream_records(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Flat rows of the arriving lines, stored by table tag; exactly once by the sink's log. Ends when all that has arrived is stored."""
    rows = flatten_records(lines(spark, folder), key="line_key")
    return rows.writeStream.partitionBy("child").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").outputMode("append").start(out)


def arrivals(candidates: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Candidates by arrival window and run; an id counts once within the lateness that the watermark allows."""
    once = candidates.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["candidate_id"])
    return once.groupBy(F.window("received_at", window).alias("w"), "run").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "run", "n")
