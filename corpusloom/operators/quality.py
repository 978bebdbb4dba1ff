"""Ordered quality rules: the first rule that a sentence fails is its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X

REASONS = ("min_length", "max_length", "language", "list_marker", "garbage", "digit_ratio", "punct_ratio", "uppercase_ratio")


def reject_reason(text: Column, script: str = "cyrillic", least: int = 20, most: int = 2000, digits: float = 0.3, puncts: float = 0.5, uppers: float = 0.8) -> Column:
    """Null for a good sentence. One conditional expression, so that later, dearer rules are not evaluated needlessly."""
    bad_marks = F.lit(False)
    for flag in X.garbage_flags(text).values():
        bad_marks |= flag
    tests = (
        F.length(text) < least,
        F.length(text) > most,
        ~X.has_script(text, script),
        X.is_list_item(text),
        bad_marks,
        X.digit_ratio(text) > digits,
        X.punct_ratio(text) > puncts,
        X.uppercase_ratio(text) > uppers,
    )
    reason = F.lit(None).cast("string")
    for name, test in reversed(list(zip(REASONS, tests, strict=True))):
        reason = F.when(test, name).otherwise(reason)
    return reason


def with_reason(sentences: DataFrame, **limits) -> DataFrame:
    """Rows with a text, and their ``reject_reason``; rows without a text are skipped."""
    return sentences.where(F.col("text") != "").withColumn("reject_reason", reject_reason(F.col("text"), **limits))


def good_sentences(sentences: DataFrame, **limits) -> DataFrame:
    return with_reason(sentences, **limits).where("reject_reason is null").drop("reject_reason")


def reason_counts(sentences: DataFrame, **limits) -> DataFrame:
    """reason, n, percent of all sentences; reason "kept" for those that pass."""
    counts = with_reason(sentences, **limits).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))  # nine rows


def kept_summary(sentences: DataFrame, **limits) -> DataFrame:
    kept = F.count_if(F.col("reject_reason").isNull())
    n = F.count(F.lit(1))
    return with_reason(sentences, **limits).agg(n.alias("total"), kept.alias("kept"), (n - kept).alias("filtered"), F.round(F.try_divide(kept * 100.0, n), 4).alias("kept_percent"))


def reason_examples(sentences: DataFrame, per_reason: int = 100, **limits) -> DataFrame:
    """Up to ``per_reason`` rows of each reason, in order of book and position. Spark keeps that many of a reason in each task
    before the shuffle, so a frequent reason costs no more than a rare one."""
    order = Window.partitionBy("reject_reason").orderBy("book_id", "position")
    bad = with_reason(sentences, **limits).where("reject_reason is not null")
    return bad.withColumn("example", F.row_number().over(order)).where(F.col("example") <= per_reason)


def quality_report(sentences: DataFrame) -> DataFrame:
    """One row of shares that a corpus should keep low: empty rows, list items, sentences without a known script."""
    text = F.coalesce(F.col("text"), F.lit(""))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return sentences.agg(share(X.utrim(text) == "").alias("empty_share"), share(X.is_list_item(text)).alias("list_share"), share(X.language_class(text) == "other").alias("other_share"))
