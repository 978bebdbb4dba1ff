"""Structured Streaming forms of the filter, the profile and the deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.quality import reject_reason
from corpusloom.schema import SENTENCE


def sentence_stream(spark: SparkSession, path: str, schema=SENTENCE, files_per_trigger: int = 1000, kind: str = "json") -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def good_stream(stream: DataFrame, **limits) -> DataFrame:
    """The quality filter: stateless, so the same expression as in batch."""
    return stream.where("text <> ''").withColumn("reject_reason", reject_reason(F.col("text"), **limits)).where("reject_reason is null").drop("reject_reason")


def reason_counts_stream(stream: DataFrame, **limits) -> DataFrame:
    """Running counts by reason; a handful of keys of state."""
    reason = F.coalesce(reject_reason(F.col("text"), **limits), F.lit("kept"))
    return stream.where("text <> ''").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def unique_stream(stream: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Sentences whose text is new. State holds one hash for each text; with an event time it is dropped after ``delay``."""
    keyed = stream.withColumn("text_md5", F.md5(F.col("text").cast("binary")))
    if time:
        return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_md5"]).drop("text_md5")
    return keyed.dropDuplicates(["text_md5"]).drop("text_md5")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet"):
    """Everything that is there now, exactly once; a second call resumes where the first ended."""
    q = stream.writeStream.outputMode(mode).format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
