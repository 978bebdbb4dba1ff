"""Vocabularies, tokenizers and token statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.functions.arrays import let
from corpusloom.operators import wordpiece
from corpusloom.operators.profile import interpolated_percentiles
from corpusloom.schema import SPECIALS

TOKEN_PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99, 99.5, 99.9)
BUCKETS = (8, 16, 24, 32, 48, 64, 96, 128, 160, 192, 256, 384, 512)
#: Entries up to which a vocabulary is broadcast; beyond, the same join shuffles.
BROADCAST_VOCAB = 500_000


def word_counts(texts: DataFrame, tokens: Column) -> DataFrame:
    """(token, n): distributed counts with partial aggregation."""
    return texts.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def frequency_vocab(texts: DataFrame, tokens: Column, size: int) -> DataFrame:
    """(token, id): the special tokens, then the ``size`` most frequent tokens; ties by token."""
    top = word_counts(texts, tokens).orderBy(F.desc("n"), "token").limit(size)
    ranked = top.select("token", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + len(SPECIALS) - 1).cast("int").alias("id"))  # ``size`` rows
    specials = texts.sparkSession.createDataFrame(list(SPECIALS.items()), "token string, id int")
    return specials.unionByName(ranked)


def vocab_from_lines(lines: DataFrame) -> DataFrame:
    """(token, id) from (line_no, value): blank lines take no id."""
    return lines.where(X.utrim(F.col("value")) != "").select(X.utrim(F.col("value")).alias("token"), (F.row_number().over(Window.orderBy("line_no")) - 1).cast("int").alias("id"))


def checked_vocab(vocab: DataFrame, most: int | None = None) -> DataFrame:
    """``vocab`` for broadcast if it is small: ``most`` is a bound known from how it was made; without one it is counted."""
    small = most <= BROADCAST_VOCAB if most is not None else vocab.limit(BROADCAST_VOCAB + 1).count() <= BROADCAST_VOCAB
    return F.broadcast(vocab) if small else vocab


def encode_fields(rows: DataFrame, vocab: DataFrame, keys: list[str], text: str = "text", most: int | None = None) -> DataFrame:
    """``keys`` and ids: words between white space looked up in the vocabulary (of ``most`` entries, if that is known), [UNK]
    for others. No word: an empty array."""
    words = rows.select(*keys, F.posexplode_outer(X.fields(F.col(text))).alias("__pos", "token"))
    found = words.join(checked_vocab(vocab, most), "token", "left").withColumn("id", F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(SPECIALS["[UNK]"]))))
    pairs = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("__pos", "id"))))
    return found.groupBy(*keys).agg(F.transform(pairs, lambda p: p["id"]).alias("ids"))


def strip_ids(ids: Column, gone: tuple[int, ...] = (SPECIALS["[CLS]"], SPECIALS["[SEP]"])) -> Column:
    return F.filter(ids, lambda x: ~x.isin(*gone))


def _wordpiece(tokens: list[str], lowercase: bool):
    """A WordPiece tokenizer over ``tokens`` by id, with BERT's normalisation."""
    from tokenizers import Tokenizer, decoders, models, normalizers, pre_tokenizers, processors

    t = Tokenizer(models.WordPiece({token: i for i, token in enumerate(tokens)}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=False, strip_accents=False, lowercase=lowercase)
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    t.decoder = decoders.WordPiece(prefix="##")
    t.add_special_tokens(list(SPECIALS))
    t.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", special_tokens=[("[CLS]", SPECIALS["[CLS]"]), ("[SEP]", SPECIALS["[SEP]"])])
    return t


def word_pieces(counts: DataFrame, lowercase: bool = False) -> DataFrame:
    """(piece, n): the words that the trainer counts, from (token, n): normalised, punctuation apart. Each token is cut once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _wordpiece(list(SPECIALS), lowercase)
        for batch in batches:
            own = [[p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(w))] for w in batch.column(0).to_pylist()]
            sizes = [len(p) for p in own]
            n = batch.column(1).take(pa.array(np.repeat(np.arange(len(own)), sizes), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([p for ps in own for p in ps], pa.string()), n], ["piece", "n"])

    return counts.select("token", "n").where(F.col("token").isNotNull()).mapInArrow(cut, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def train_wordpiece_vocab(counts: DataFrame, vocab_size: int, min_frequency: int = 2, limit_alphabet: int = 1000, lowercase: bool = False) -> list[str]:
    """The tokens by id that WordPiece training gives from (token, n) counts.

    Spark reduces the corpus to distinct words and cuts these; one process, the driver, holds every word at ``min_frequency``
    or above once, with its count, and merges. A larger ``min_frequency`` makes these words fewer.
    """
    rows = word_pieces(counts.where(F.col("n") >= min_frequency), lowercase).orderBy(F.desc("n"), "piece").toArrow()
    return wordpiece.train_vocab(rows.column("piece").combine_chunks(), rows.column("n").to_numpy(), vocab_size, list(SPECIALS), min_frequency, limit_alphabet)


def train_wordpiece(counts: DataFrame, vocab_size: int, min_frequency: int = 2, limit_alphabet: int = 1000, lowercase: bool = False):
    """A WordPiece tokenizer from (token, n) counts (``train_wordpiece_vocab``)."""
    return _wordpiece(train_wordpiece_vocab(counts, vocab_size, min_frequency, limit_alphabet, lowercase), lowercase)


def encoder(tokenizer_json: str, specials: bool = True):
    """An Arrow-batched function from text to ids; the tokenizer is loaded once a worker, whole batches are encoded at once."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(tokenizer_json)
        for texts in batches:
            yield pd.Series([e.ids for e in t.encode_batch(texts.fillna("").tolist(), add_special_tokens=specials)])

    return encode


def truncate(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def token_stats(rows: DataFrame, n: Column) -> DataFrame:
    """One row: sentences, tokens, avg, min, max, population deviation of token counts ``n``."""
    return rows.agg(
        F.count(F.lit(1)).alias("total_sentences"),
        F.sum(n).cast("long").alias("total_tokens"),
        F.round(F.avg(n), 6).alias("avg_tokens"),
        F.min(n).alias("min_tokens"),
        F.max(n).alias("max_tokens"),
        F.round(F.stddev_pop(n), 6).alias("std_tokens"),
    )


def token_percentiles(rows: DataFrame, n: Column) -> DataFrame:
    return interpolated_percentiles(rows, n, TOKEN_PERCENTS)


def cumulative_coverage(rows: DataFrame, n: Column, buckets: tuple[int, ...] = BUCKETS) -> DataFrame:
    """bucket, n, percent of rows with at most so many tokens; one pass."""
    one = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(n <= b).alias(f"b{b}") for b in buckets])
    long = one.select("total", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"b{b}").alias("n")) for b in buckets])).alias("r"))
    return long.select("r.bucket", "r.n", F.round(F.try_divide(F.col("r.n") * 100.0, "total"), 2).alias("percent"))


def recommended_length(coverage: DataFrame, targets: tuple[float, ...] = (99.0, 99.5, 99.9)) -> DataFrame:
    """target, max_seq_length: the least bucket that covers it (null if none does)."""
    return coverage.select(F.explode(F.array(*map(F.lit, targets))).alias("target"), "bucket", "percent").groupBy("target").agg(F.min(F.when(F.col("percent") >= F.col("target"), F.col("bucket"))).alias("max_seq_length"))


def long_shares(rows: DataFrame, n: Column, least: int, file: str) -> DataFrame:
    """Per file: total, long, percent; ``n`` counts [CLS] and [SEP] too."""
    return rows.groupBy(file).agg(F.count(F.lit(1)).alias("total"), F.count_if(n >= least).alias("long"), F.round(F.count_if(n >= least) * 100.0 / F.count(F.lit(1)), 4).alias("percent"))


def word_coverage(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: words, covered, coverage: distinct words (token) that are whole, case-folded entries of the vocabulary."""
    entries = vocab.where(~F.col("token").startswith("##")).select(F.lower("token").alias("token")).distinct()
    own = words.select("token").distinct()
    flagged = own.join(entries.withColumn("__in", F.lit(1)), "token", "left")
    return flagged.agg(F.count(F.lit(1)).alias("words"), F.count("__in").alias("covered"), F.round(F.try_divide(F.count("__in"), F.count(F.lit(1))), 6).alias("coverage"))


def word_coverage_by_size(words: DataFrame, tokens: list[str], sizes: tuple[int, ...]) -> DataFrame:
    """``word_coverage`` with vocab_size, a row for each of ``sizes``: the vocabularies are beginnings of ``tokens``, so one pass
    over the distinct words finds for each the smallest size that holds it."""
    least: dict[str, int] = {}
    for size in sorted(sizes):
        for t in wordpiece.first_tokens(tokens, size, len(SPECIALS)):
            if not t.startswith("##"):
                least.setdefault(t.lower(), size)
    entries = words.sparkSession.createDataFrame(list(least.items()), "token string, __least int")
    own = words.select("token").distinct().join(checked_vocab(entries, len(tokens)), "token", "left")
    one = own.agg(F.count(F.lit(1)).alias("words"), *[F.count_if(F.col("__least") <= s).alias(f"__{s}") for s in sizes])
    rows = one.select("words", F.explode(F.array(*[F.struct(F.col(f"__{s}").alias("covered"), F.lit(s).alias("vocab_size")) for s in sizes])).alias("c"))
    return rows.select("words", "c.covered", F.round(F.try_divide("c.covered", "words"), 6).alias("coverage"), "c.vocab_size")


def token_coverage(encoded: DataFrame, ids: Column) -> DataFrame:
    """One row: tokens, unknown, coverage = 1 - unknown / tokens."""
    unknown = F.sum(F.size(F.filter(ids, lambda x: x == SPECIALS["[UNK]"])))
    total = F.sum(F.size(ids))
    return encoded.agg(total.cast("long").alias("tokens"), unknown.cast("long").alias("unknown"), F.round(1 - F.try_divide(unknown, total), 6).alias("coverage"))


def knee(coverages: DataFrame, least_gain: float = 0.001) -> DataFrame:
    """vocab_size of the first size that gains less than ``least_gain`` over the one before."""
    w = Window.orderBy("vocab_size")  # a row for each size tried
    return coverages.withColumn("gain", F.col("coverage") - F.lag("coverage").over(w)).where(F.col("gain") < least_gain).agg(F.min("vocab_size").alias("vocab_size"))


def longest(rows: DataFrame, n: Column, top: int) -> DataFrame:
    """The ``top`` longest rows, by token count, book, position, text: a top-k in every task, then one merge."""
    return rows.withColumn("token_length", n).orderBy(F.desc("token_length"), F.desc("book_id"), F.desc("position"), F.desc("text")).limit(top)


def subsequence_at(tokens: Column, part: Column) -> Column:
    """The first 0-based index at which ``part`` occurs in ``tokens`` contiguously, -1 if nowhere."""

    def search(own: Column, sought: Column) -> Column:
        last = F.size(own) - F.size(sought)
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        at = F.filter(starts, lambda i: F.slice(own, i + 1, F.size(sought)) == sought)
        return F.coalesce(F.get(at, F.lit(0)), F.lit(-1))

    return let(tokens, lambda own: let(part, lambda sought: search(own, sought)))


def join_pieces(pieces: Column) -> Column:
    return F.replace(F.array_join(pieces, ""), F.lit("##"), F.lit(""))
