"""Books to sentences, and the relations that the other operators start from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def explode_sentences(books: DataFrame, segmenter: Callable[[Column], Column] = X.segment, text: str = "text") -> DataFrame:
    """One row a sentence: the books' columns without ``text``, then position (from 0) and text. Narrow: no shuffle.

    ``segmenter`` maps a text column to an array of sentences; ``pandas_segmenter`` makes one from a Python splitter.
    Sentences with line ends fall into lines; blank ones go and do not count.
    """
    lines = F.filter(F.transform(F.flatten(F.transform(segmenter(F.col(text)), lambda s: F.split(s, "\n"))), X.utrim), lambda s: s != "")
    others = [c for c in books.columns if c != text]
    return books.select(*others, F.posexplode(lines).alias("position", "text"))


def pandas_segmenter(split: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A third-party splitter as an Arrow-batched function; a text that it fails on gives no sentences."""

    @F.pandas_udf("array<string>")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: _safe(split, t))

    return segment


def _safe(split: Callable[[str], list[str]], text: str | None) -> list[str]:
    try:
        return [str(s) for s in split(text)] if text else []
    except Exception:  # one bad item of a batch must not fail the others
        return []


def corpus_lines(sentences: DataFrame, strip_scripts: bool = False) -> DataFrame:
    """The text column alone, for a plain-text corpus: foreign scripts off on request, blank lines dropped."""
    text = X.strip_cjk_thai(F.col("text")) if strip_scripts else F.col("text")
    return sentences.select(text.alias("text")).where(X.utrim(F.col("text")) != "")


def ingest_summary(files: DataFrame) -> DataFrame:
    """One row: total, processed, errors, skipped, approx_sentences of (text, error) rows, an empty text being skipped."""
    text, failed = F.col("text"), F.col("error").isNotNull()
    blank = ~failed & (F.coalesce(text, F.lit("")) == "")
    return files.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~failed & ~blank).alias("processed"),
        F.count_if(failed).alias("errors"),
        F.count_if(blank).alias("skipped"),
        F.coalesce(F.sum(F.when(~failed & ~blank, X.approx_sentences(text))), F.lit(0)).cast("long").alias("approx_sentences"),
    )
