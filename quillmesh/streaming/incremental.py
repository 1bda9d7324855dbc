"""Structured Streaming forms: a first-wins feed of records and the incremental plan per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_doi
from ..operators.incremental import build_plan
from ..sources.records import note_inventory


def first_of_each_doi(records: DataFrame, event_time: str, late: str = "1 day") -> DataFrame:
    """Records of a stream with DOIs seen before dropped; state is kept for the watermark only."""
    keyed = records.withColumn("_doi", normalize_doi("doi")).filter("_doi <> ''")
    return keyed.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["_doi"]).drop("_doi")


def windowed_counts(events: DataFrame, event_time: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per tumbling window and value; late rows beyond the watermark are left out."""
    return events.withWatermark(event_time, late).groupBy(F.window(event_time, width), value).agg(F.count("*").alias("n"))


def plan_stream(captures: DataFrame, notes_path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Plan every micro-batch of captured records against the notes as they are then."""

    def plan(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        notes = spark.read.text(notes_path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        build_plan(batch, note_inventory(notes)).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return captures.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
