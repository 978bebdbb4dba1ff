"""Masked-language-model data: token masking, word masking, prediction cleanup and accuracy. Draws are MD5 based."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.arrays import let
from corpusloom.schema import SPECIALS

KEPT = (SPECIALS["[CLS]"], SPECIALS["[SEP]"], SPECIALS["[PAD]"])
IGNORE = -100
PUNCTUATION = ".,!?;:()[]«»\"'`…"
# Tokens that are no prediction.
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]")
PUNCTUATION_TOKENS = (".", ",", ":", ";", "!", "?", "—", "-", "«", "»", "(", ")", "[", "]", '"', "'", "``", "''", "…")


def _hash(key: Column, i: Column, salt: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"), F.lit(salt), F.lit(str(seed))).cast("binary"))


def _below(digest: Column, p: float) -> Column:
    """A draw in [0, 1) from the digest's first 8 digits is under p."""
    return F.left(digest, F.lit(8)) < F.lit(f"{round(p * (1 << 32)):08x}") if p < 1 else F.lit(True)


def _number(digest: Column, modulus: int) -> Column:
    return (F.conv(F.substring(digest, 9, 6), 16, 10).cast("long") % modulus).cast("int")


def mask_tokens(ids: Column, key: Column, vocab_size: int, p: float = 0.15, seed: int = 42) -> Column:
    """struct(masked_ids, labels): of the positions drawn, 80 % become [MASK], 10 % any id, 10 % stay; labels elsewhere are -100."""

    def masked(x: Column, i: Column) -> Column:
        drawn = ~x.isin(*KEPT) & _below(_hash(key, i, "m", seed), p)
        replaced = _below(_hash(key, i, "r", seed), 0.8)
        other = _below(_hash(key, i, "o", seed), 0.5)
        return F.when(drawn & replaced, SPECIALS["[MASK]"]).when(drawn & other, _number(_hash(key, i, "n", seed), vocab_size)).otherwise(x)

    labels = F.transform(ids, lambda x, i: F.when(~x.isin(*KEPT) & _below(_hash(key, i, "m", seed), p), x).otherwise(IGNORE))
    return F.struct(F.transform(ids, masked).alias("masked_ids"), labels.alias("labels"))


def mask_query(ids: Column, tokens: Column, key: Column, p: float = 0.3, smart: bool = True, seed: int = 42) -> Column:
    """Ids with [MASK] at drawn positions; specials stay, and if ``smart`` tokens under 3 characters and continuations."""

    def masked(x: Column, i: Column) -> Column:
        may = ~x.isin(*KEPT)
        if smart:
            t = F.get(tokens, i)
            may &= (F.length(t) >= 3) & ~t.startswith("##")
        return F.when(may & _below(_hash(key, i, "q", seed), p), SPECIALS["[MASK]"]).otherwise(x)

    return F.transform(ids, masked)


def strip_marks(word: Column) -> Column:
    return F.trim(word, F.lit(PUNCTUATION))


def mask_random_word(text: Column, key: Column, seed: int = 42) -> Column:
    """struct(masked, original): one word of more than a character, drawn by key, becomes [MASK] if there are 4 words or more."""
    def pick(words: Column) -> Column:
        indexed = F.transform(words, lambda w, i: F.struct(i.alias("i"), F.length(strip_marks(w)).alias("n")))
        candidates = F.transform(F.filter(indexed, lambda c: c["n"] > 1), lambda c: c["i"])
        number = F.conv(F.left(_hash(key, F.lit(0), "w", seed), F.lit(6)), 16, 10).cast("long")
        return F.when(F.size(words) >= 4, let(candidates, lambda c: F.get(c, (number % F.greatest(F.size(c), F.lit(1))).cast("int"))))

    return _masked_word(text, pick)


def mask_first_long_word(text: Column, longer_than: int = 4) -> Column:
    """struct(masked, original): the first word of more than ``longer_than`` letters becomes [MASK]."""

    def pick(words: Column) -> Column:
        long = F.transform(words, lambda w, i: F.when(F.length(strip_marks(w)) > longer_than, i))
        return F.get(F.filter(long, lambda i: i.isNotNull()), F.lit(0))

    return _masked_word(text, pick)


def _masked_word(text: Column, pick: Callable[[Column], Column]) -> Column:
    """struct(masked, original) with the word at ``pick(words)`` masked; a null index masks nothing."""

    def replaced(words: Column, at: Column) -> Column:
        masked = F.array_join(F.transform(words, lambda w, i: F.when(i == at, "[MASK]").otherwise(w)), " ")
        return F.struct(F.when(at.isNotNull(), masked).otherwise(text).alias("masked"), strip_marks(F.get(words, at)).alias("original"))

    return let(X.fields(text), lambda words: let(pick(words), lambda at: replaced(words, at)))


def clean_predictions(tokens: Column, k: int = 10) -> Column:
    """Ranked tokens without specials and punctuation, stripped, each once at its best rank, the first k."""
    real = F.filter(tokens, lambda t: ~t.isin(*SPECIAL_TOKENS, *PUNCTUATION_TOKENS))
    return F.slice(F.array_distinct(F.filter(F.transform(real, strip_marks), lambda t: t != "")), 1, k)


def usable_variations(query: Column, variations: Column, n: int = 3) -> Column:
    """Variations that are neither empty nor the query, with a length within 80 % of the query's; the first n."""
    near = lambda v: (v != "") & (v != query) & (F.abs(F.length(v) - F.length(query)) / F.greatest(F.length(query), F.lit(1)) < 0.8)
    return F.slice(F.filter(variations, near), 1, n)


def accuracy(results: DataFrame, by: str | None = None) -> DataFrame:
    """total, correct, accuracy of (is_correct) rows, overall or by a column."""
    grouped = results.groupBy(by) if by else results.groupBy()
    c = F.count_if(F.col("is_correct"))
    return grouped.agg(F.count(F.lit(1)).alias("total"), c.alias("correct"), F.round(F.try_divide(c * 1.0, F.count(F.lit(1))), 6).alias("accuracy"))


def probe_positions(words: Column, per_sentence: int = 2) -> Column:
    """Of the first ``per_sentence`` multi-piece words (arrays of pieces): structs (word_no, place, index) of the first, last
    and, from three pieces on, middle piece."""
    chosen = F.slice(words, 1, per_sentence)

    def places(w: Column, i: Column) -> Column:
        n = F.size(w)
        row = lambda place, at: F.struct(i.alias("word_no"), F.lit(place).alias("place"), at.cast("int").alias("index"))
        return F.filter(F.array(row("first", F.lit(0)), F.when(n >= 2, row("last", n - 1)), F.when(n >= 3, row("middle", F.floor(n / 2)))), lambda r: r.isNotNull())

    return F.flatten(F.transform(chosen, places))


def best_epoch(metrics: DataFrame) -> DataFrame:
    """One row: the epoch of the least validation loss, that loss and its perplexity."""
    return metrics.agg(F.min_by("epoch", "val_loss").alias("best_epoch"), F.min("val_loss").alias("best_val_loss"), F.round(F.exp(F.min("val_loss")), 6).alias("perplexity"))
