"""Ordered packing of a book's sentences into fixed-length training examples.

A greedy scan is a fold over one book's sentences in order. Rows are dealt by book, sorted, and stream through their task,
so that memory does not depend on a book's size; what is carried is one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.schema import SPECIALS


def greedy_groups(lengths: DataFrame, limit: int, start: int = 2, per_sentence: int = 1, reserve: int = 0) -> DataFrame:
    """(book_id, position, n) with group_no: a sentence opens a new group if the current one isn't empty and
    used + n + per_sentence + reserve would exceed ``limit``; a group's use starts at ``start``.

    The exact rule has start 2 and one separator a sentence; the simpler one start 0, no separator and a reserve of 2.
    """
    kind = lengths.schema["book_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, group, used, empty = object(), 0, start, True
        for batch in batches:
            out = []
            for b, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != book:
                    book, group, used, empty = b, 0, start, True
                if not empty and used + n + per_sentence + reserve > limit:
                    group, used = group + 1, start
                used += n + per_sentence
                empty = False
                out.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], ["book_id", "position", "n", "group_no"])

    rows = lengths.select("book_id", F.col("position").cast("long").alias("position"), F.col("n").cast("long").alias("n"))
    return rows.repartition("book_id").sortWithinPartitions("book_id", "position").mapInArrow(run, f"book_id {kind}, position long, n long, group_no int")


def estimated_tokens(text: Column) -> Column:
    """The debugging estimate of a sentence's tokens."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3.5))


def encode_group(sentences: Column, limit: int) -> Column:
    """struct(input_ids, attention_mask, token_type_ids) of exactly ``limit`` items from an array of id arrays:
    [CLS] s1 [SEP] s2 [SEP] ..., cut to ``limit``, padded with zeros."""
    sep = F.array(F.lit(SPECIALS["[SEP]"]))
    ids = F.concat(F.array(F.lit(SPECIALS["[CLS]"])), F.flatten(F.transform(sentences, lambda s: F.concat(s, sep))))
    return _fixed(F.slice(ids, 1, limit), limit)


def encode_flat(ids: Column, limit: int) -> Column:
    """As above for one array of ids: cut to limit - 2, [CLS] before, [SEP] behind."""
    return _fixed(F.concat(F.array(F.lit(SPECIALS["[CLS]"])), F.slice(ids, 1, limit - 2), F.array(F.lit(SPECIALS["[SEP]"]))), limit)


def _fixed(ids: Column, limit: int) -> Column:
    pad = F.array_repeat(F.lit(0), limit - F.size(ids))
    return F.struct(
        F.concat(ids, pad).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(ids)), pad).alias("attention_mask"),
        F.array_repeat(F.lit(0), F.lit(limit)).alias("token_type_ids"),
    )


def grouped_ids(encoded: DataFrame, groups: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """(book_id, group_no, sentences: array of id arrays in order); a group holds at most a few hundred ids."""
    j = encoded.join(groups.select("book_id", "position", "group_no"), ["book_id", "position"])
    pairs = F.array_sort(F.collect_list(F.struct("position", "ids")))
    return j.groupBy("book_id", "group_no").agg(F.transform(pairs, lambda p: p["ids"]).alias("sentences"), *[F.min_by(c, "position").alias(c) for c in others])


def build_examples(encoded: DataFrame, limit: int = 512) -> DataFrame:
    """(book_id, group_no, input_ids, attention_mask, token_type_ids) by the exact rule from (book_id, position, ids)."""
    lengths = encoded.select("book_id", "position", F.size("ids").alias("n"))
    groups = greedy_groups(lengths, limit)
    return grouped_ids(encoded, groups).select("book_id", "group_no", encode_group(F.col("sentences"), limit).alias("e")).select("book_id", "group_no", "e.*")


def build_examples_flat(encoded: DataFrame, limit: int = 512) -> DataFrame:
    """By the simpler rule; with labels (-100 everywhere) and is_next (always true)."""
    lengths = encoded.select("book_id", "position", F.size("ids").alias("n"))
    groups = greedy_groups(lengths, limit, start=0, per_sentence=0, reserve=2)
    flat = grouped_ids(encoded, groups).select("book_id", "group_no", encode_flat(F.flatten("sentences"), limit).alias("e"))
    return flat.select("book_id", "group_no", "e.*", F.array_repeat(F.lit(-100), F.lit(limit)).alias("labels"), F.lit(True).alias("is_next"))


def sentence_pairs(sentences: DataFrame) -> DataFrame:
    """Each sentence with the next one of its book, for next-sentence tasks."""
    from pyspark.sql.window import Window

    nxt = F.lead("text").over(Window.partitionBy("book_id").orderBy("position"))
    return sentences.select("book_id", "position", F.col("text").alias("first"), nxt.alias("second")).where("second is not null")
