"""Sinks. All overwrite: running twice gives the same files, not twice the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sentences_by_book(sentences: DataFrame, path: str) -> None:
    """JSON lines in a folder for each book."""
    sentences.repartition("book_id").sortWithinPartitions("book_id", "position").write.mode("overwrite").partitionBy("book_id").json(path)


def jsonl_parts(rows: DataFrame, path: str, parts: int = 10_000, key: str | None = "book_id") -> None:
    """``parts`` gzipped files of JSON lines; by ``key`` a book stays in one file, without it rows are dealt in turn."""
    dealt = rows.repartition(parts, key) if key else rows.repartition(parts)
    dealt.write.mode("overwrite").option("compression", "gzip").json(path)


def corpus_text(lines: DataFrame, path: str, single: bool = False) -> None:
    """A plain-text corpus, one sentence a line; ``single`` for consumers that need one file."""
    (lines.coalesce(1) if single else lines).select("text").write.mode("overwrite").text(path)


def json_summary(row: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def csv(rows: DataFrame, path: str, order: list | None = None, separator: str = ",", decimals: int | None = 4, single: bool | None = None) -> None:
    """A report as CSV; doubles with ``decimals`` places. With an ``order`` it is one ordered file, for reports of a few rows;
    without one each task writes its own rows, since a row for each sentence or book may be many. ``single`` overrides that;
    the rows are computed before they meet in one task."""
    if decimals is not None:
        rows = rows.withColumns({f.name: F.format_string(f"%.{decimals}f", f.name) for f in rows.schema.fields if f.dataType.simpleString() == "double"})
    if order:
        rows = rows.orderBy(*order).coalesce(1) if single is not False else rows.orderBy(*order)
    elif single:
        rows = rows.repartition(1)
    rows.write.mode("overwrite").option("header", "true").option("sep", separator).csv(path)


def examples(rows: DataFrame, path: str, parts: int = 100, by_book: bool = False) -> None:
    """Training examples by split (and book), at most ``parts`` files a split."""
    dealt = rows.repartition(parts, "book_id")
    dealt.write.mode("overwrite").partitionBy(*(["split", "book_id"] if by_book else ["split"])).json(path)


def vocab(rows: DataFrame, path: str) -> None:
    rows.orderBy("id").coalesce(1).select("token").write.mode("overwrite").text(path)


def removed_scripts_log(books: DataFrame, path: str) -> None:
    """Books that held foreign scripts before cleaning, as a TSV log."""
    from corpusloom.functions.text import has_cjk_thai

    csv(books.where(has_cjk_thai(F.col("text"))).select("filename", "title", "author", "genre"), path, separator="\t")


def embedding_index(rows: DataFrame, path: str, append: bool = False) -> None:
    """(id, embedding, metadata...) as Parquet; ``append`` adds rows."""
    rows.write.mode("append" if append else "overwrite").parquet(path)
