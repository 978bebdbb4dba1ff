"""Corpus profiles: counters, length statistics, histograms, exact percentiles.

Percentiles come from a histogram of lengths, never from a sort of the rows: lengths take few values, so the histogram
is small whatever the corpus' size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X

PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)
EDGES = (0, 20, 50, 100, 200, 500, 1000, 2000, 5000)


def measured(sentences: DataFrame, unit: str = "bytes") -> DataFrame:
    """``sentences`` with their measures as columns, so that each is computed once a row however many counters use it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return sentences.withColumns(
        {
            "text": text,
            "__n": X.size(text, unit),
            "__digits": X.digit_ratio(text, unit),
            "__puncts": X.punct_ratio(text, unit),
            "__upper": X.uppercase_ratio(text),
            "__lang": X.language_class(text),
        }
    )


def metric_flags() -> dict[str, Column]:
    """The quality counters of a profile, by name, over ``measured`` rows."""
    text, n, digits, puncts, upper = (F.col(c) for c in ("text", "__n", "__digits", "__puncts", "__upper"))
    flags = {
        "short_20": n < 20,
        "short_50": n < 50,
        "long_1000": n > 1000,
        "long_2000": n > 2000,
        "digit_10": digits > 0.1,
        "digit_30": digits > 0.3,
        "digit_50": digits > 0.5,
        "punct_30": puncts > 0.3,
        "punct_50": puncts > 0.5,
        "upper_50": upper > 0.5,
        "upper_80": upper > 0.8,
        "list_marker": X.is_list_item(text),
    }
    return flags | {f"has_{k}": v for k, v in X.garbage_flags(text).items()}


def profile(sentences: DataFrame, unit: str = "bytes") -> DataFrame:
    """One row: totals, language counts and all quality counters, in one pass."""
    there, lang = F.col("text") != "", F.col("__lang")
    return measured(sentences, unit).agg(
        F.count_if(there).alias("total_sentences"),
        F.count_if(~there).alias("empty_sentences"),
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("total_chars"),
        *[F.count_if(there & (lang == k)).alias(k) for k in ("russian", "english", "mixed", "other")],
        *[F.count_if(there & c).alias(k) for k, c in metric_flags().items()],
    )


def metric_percentages(sentences: DataFrame, unit: str = "bytes") -> DataFrame:
    """metric, n, percent: the profile's counters as rows."""
    p = profile(sentences, unit)
    names = [c for c in p.columns if c not in ("total_sentences", "empty_sentences", "total_chars")]
    long = p.select("total_sentences", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in names])).alias("m"))
    return long.select("m.metric", "m.n", F.round(F.try_divide(F.col("m.n") * 100.0, "total_sentences"), 4).alias("percent"))


def length_summary(sentences: DataFrame, unit: str = "bytes") -> DataFrame:
    n = X.size(F.col("text"), unit)
    return sentences.where("text <> ''").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.round(F.avg(n), 6).alias("avg_length"))


def histogram(values: DataFrame, value: Column) -> DataFrame:
    """(v, n) with the running count up to and with v."""
    h = values.select(value.cast("long").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("upto", F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def percentiles(values: DataFrame, value: Column, percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    """(p, value): the element at index floor(n p / 100) of the sorted values, the last one at most."""
    h = histogram(values, value)
    total = h.agg(F.sum("n").alias("total"))
    want = total.select("total", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("p"))
    rank = F.least(F.floor(F.col("total") * F.col("p") / 100), F.col("total") - 1) + 1
    found = h.join(F.broadcast(want.withColumn("rank", rank)), (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))  # one row for each percentage
    return found.select("p", F.col("v").alias("value"))


def interpolated_percentiles(values: DataFrame, value: Column, percents: tuple[float, ...]) -> DataFrame:
    """(p, value): linear interpolation between neighbours, truncated to an integer."""
    h = histogram(values, value)
    total = h.agg(F.sum("n").alias("total"))
    want = total.select(F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("p"), ((F.col("total") - 1) * F.col("p") / 100).alias("at"))
    lo, hi = F.floor("at") + 1, F.ceil("at") + 1
    inside = lambda r: (F.col("upto") >= r) & (F.col("upto") - F.col("n") < r)
    near = h.join(F.broadcast(want), inside(lo) | inside(hi))
    ends = near.groupBy("p", "at").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return ends.select("p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).cast("int").alias("value"))


def length_histogram(sentences: DataFrame, width: int = 100, unit: str = "bytes") -> DataFrame:
    """bucket ("b-(b+width)"), n."""
    low = F.floor(X.size(F.col("text"), unit) / width) * width
    counts = sentences.where("text <> ''").groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.concat_ws("-", "low", F.col("low") + width).alias("bucket"), "n")


def edge_histogram(sentences: DataFrame, edges: tuple[int, ...] = EDGES, unit: str = "chars") -> DataFrame:
    """bucket, n for uneven edges; the last bucket is open."""
    n = X.size(F.col("text"), unit)
    label = F.lit(f"{edges[-1]}+")
    for a, b in zip(edges[-2::-1], edges[:0:-1], strict=True):
        label = F.when(n < b, f"{a}-{b}").otherwise(label)
    return sentences.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def file_profile(sentences: DataFrame, file: str = "book_id", unit: str = "bytes") -> DataFrame:
    """Per file: sentences and six ratios; garbage_ratio sums five flags and may exceed 1."""
    lang, flags = F.col("__lang"), metric_flags()
    garbage = sum((flags[f"has_{k}"].cast("int") for k in ("isbn", "udk", "bbk", "url", "email")), F.lit(0))
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    return measured(sentences.where("text <> ''"), unit).groupBy(file).agg(
        F.count(F.lit(1)).alias("sentences"),
        *[share(lang == k).alias(f"{k}_ratio") for k in ("russian", "english", "mixed")],
        share(flags["digit_30"]).alias("digit_30_ratio"),
        share(flags["list_marker"]).alias("list_ratio"),
        share(garbage).alias("garbage_ratio"),
    )


def filtered_profile(sentences: DataFrame, unit: str = "chars") -> DataFrame:
    """metric, value rows: total, chars, min, max, avg and percentiles of a filtered corpus."""
    s = sentences.where("text <> ''")
    n = X.size(F.col("text"), unit)
    one = s.agg(F.count(F.lit(1)).cast("double").alias("total"), F.sum(n).cast("double").alias("chars"), F.min(n).cast("double").alias("min"), F.max(n).cast("double").alias("max"), F.round(F.avg(n), 6).alias("avg"))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in one.columns])).alias("m")).select("m.*")
    return rows.unionByName(percentiles(s, n).select(F.format_string("p%d", F.col("p").cast("int")).alias("metric"), F.col("value").cast("double").alias("value")))


def dataset_stats(sentences: DataFrame) -> DataFrame:
    """One row: books, sentences, characters, quartiles of length (index rule), sentences per book."""
    n = F.length("text")
    per_book = sentences.groupBy("book_id").agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("c"))
    books = per_book.agg(F.count(F.lit(1)).alias("books"), F.sum("k").alias("sentences"), F.sum("c").alias("chars"), F.min("k").alias("book_min"), F.max("k").alias("book_max"), F.round(F.avg("k"), 6).alias("book_avg"))
    q = percentiles(sentences, n, (0, 25, 50, 75, 100))
    wide = q.agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for p, name in ((0, "length_min"), (25, "length_q1"), (50, "length_median"), (75, "length_q3"), (100, "length_max"))])
    return books.withColumn("avg_chars", F.round(F.col("chars") / F.col("sentences"), 6)).crossJoin(wide)  # one row each


def count_by(sentences: DataFrame, key: str) -> DataFrame:
    return sentences.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)
