"""Exact deduplication by MD5 of the text, and the statistics of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_dedup(sentences: DataFrame, order: tuple[str, ...] = ("book_id", "position")) -> DataFrame:
    """One row of each text: the first by ``order``. The rank limit is applied in each task before the shuffle, so copies
    of one text cost one row a task."""
    first = Window.partitionBy(F.md5(F.col("text").cast("binary"))).orderBy(*order)
    return sentences.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def duplicate_stats(sentences: DataFrame) -> DataFrame:
    """One row: total, unique, exact duplicates and their share. Counts by hash first, so no task sees all copies."""
    by = sentences.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total, unique = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return by.agg(total.alias("total"), unique.alias("unique_texts"), (total - unique).alias("exact_duplicates"), F.round(F.try_divide((total - unique) * 100.0, total), 4).alias("duplicate_percent"))


def new_sentences(sentences: DataFrame, seen: DataFrame) -> DataFrame:
    """Sentences whose text no earlier batch ``seen`` holds, each once."""
    return exact_dedup(sentences.join(seen.select("text").distinct(), "text", "left_anti").select(*sentences.columns))
