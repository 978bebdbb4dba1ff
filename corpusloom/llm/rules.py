"""Quality rules: a decision list learned by sequential covering.

Each text gives a few statistics. From labelled rows (label 0: bad) a list of rules is learned: a rule is a conjunction of
thresholds, grown literal by literal for FOIL's information gain on two thirds of the rows not yet covered, then pruned
on the other third (final literals go while (p - n) / (p + n) doesn't fall). Rules are added while they are precise
enough on rows set aside; what a rule covers is taken away and the next is learned. The list is an ordered Spark
conditional expression, first match wins, and its branches can be read.

The fit takes ``FIT_ROWS`` labelled rows at most, chosen by a hash of doc_id; statistics and verdicts take every row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, column, utf8

#: Labelled rows of a fit, at most.
FIT_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LITERALS = 4
MAX_RULES = 12
MIN_COVER = 8
MIN_PRECISION = 0.9
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct_words", "n_same_neighbours")
#: Statistics that rules test, as ratios of the counts above.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "same_neighbour_share": ("n_same_neighbours", "n_words"),
}
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_NOT_MARK = bytes(b for b in range(256) if b not in b"!?;:")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) > len(words) - window:  # a window that comes twice, even overlapping itself, repeats ``window`` words at least
        return 0
    span = 1
    while span < window:  # ids of windows of 2, 4, 8 ... words: equal ids are equal windows
        step = min(span, window - span)
        pairs = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        span += step
    twice = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` and ``EXTRA`` of one text; all zero for a null, empty or wordless text but n_lines, 1 at least."""
    raw = utf8(text)
    words = raw.split()
    glued = b"".join(words)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        lines += 1
        if line.split(None, 1):
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(glued.translate(None, _NOT_CONTINUATION)),
        len(glued.translate(None, _NOT_SYMBOL)),
        dup,
        repeated_words(words),
        lines,
        len(glued.translate(None, _NOT_UPPER)),
        len(glued.translate(None, _NOT_LETTER)),
        len(glued.translate(None, _NOT_DIGIT)),
        len(glued.translate(None, _NOT_MARK)),
        len(set(words)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (text; other columns are kept) with ``__stats``, a struct of ``COUNTS`` and ``EXTRA``; no shuffle."""
    names = [*COUNTS, *EXTRA]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array([statistics_of(t) for t in column(batch, "text").to_pylist()], np.int64)
            stats = pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names)
            return pa.RecordBatch.from_arrays([*batch.columns, stats], [*batch.schema.names, "__stats"])

        return step

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["__stats struct<" + ", ".join(f"{n}: bigint" for n in names) + ">"])
    return arrow_map(docs, make, schema)


def feature(name: str, stats: str = "__stats") -> Column:
    """A feature as a double; a ratio with nothing below the line is 0."""
    over, under = FEATURES[name]
    value = F.col(f"{stats}.{over}").cast("double")
    return value if under is None else F.when(F.col(f"{stats}.{under}") > 0, value / F.col(f"{stats}.{under}")).otherwise(0.0)


def base_failed(stats: str = "__stats") -> Column:
    return (F.col(f"{stats}.n_words") < MIN_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{stats}.n_words"))


@dataclass
class Literal:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, stats: str = "__stats") -> Column:
        v = feature(self.feature, stats)
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first whose literals all hold rejects the row. No rules: everything is kept."""

    rules: list[list[Literal]] = field(default_factory=list)

    def rejects(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for rule in self.rules:
            out |= _covers(rule, x)
        return out

    def rule(self, stats: str = "__stats") -> Column:
        """The text of the first rule that holds, null if none does: an ordered conditional expression."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            condition = F.lit(True)
            for literal in rule:
                condition &= literal.column(stats)
            out = F.when(condition, F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out


def _covers(rule: list[Literal], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for literal in rule:
        out &= literal.holds(x)
    return out


def _best_literal(x: np.ndarray, bad: np.ndarray) -> tuple[float, Literal | None]:
    """The literal of the highest FOIL gain on the rows covered so far."""
    p0, n0 = bad.sum(), (~bad).sum()
    if not p0 or not n0:
        return 0.0, None
    before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for k, name in enumerate(FEATURES):
        order = np.argsort(x[:, k], kind="stable")
        v, y = x[order, k], bad[order]
        ends = np.flatnonzero(v[1:] != v[:-1])
        if not len(ends):
            continue
        p_low, low = np.cumsum(y)[ends], ends + 1
        for above, p, n in ((False, p_low, low - p_low), (True, p0 - p_low, n0 - (low - p_low))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                at = ends[i]
                best = float(gain[i]), Literal(name, above, float((v[at] + v[at + 1]) / 2))
    return best


def _precision(rule: list[Literal], x: np.ndarray, bad: np.ndarray) -> tuple[int, float]:
    own = bad[_covers(rule, x)]
    return len(own), (own.sum() + 0.5) / (len(own) + 1)


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 3) -> DecisionList:
    """``x``: rows of ``FEATURES``; ``bad``: True for label 0. Without rows of both kinds the list is empty."""
    rng, found = np.random.default_rng(seed), DecisionList()
    part = rng.random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    while len(found.rules) < MAX_RULES and bad[left].sum() >= MIN_COVER:
        grow, prune, rule = left & part, left & ~part, []
        while len(rule) < MAX_LITERALS:
            inside = grow & _covers(rule, x)
            gain, literal = _best_literal(x[inside], bad[inside])
            if literal is None or gain <= 0:
                break
            rule.append(literal)
        while len(rule) > 1 and _precision(rule[:-1], x[prune], bad[prune])[1] >= _precision(rule, x[prune], bad[prune])[1]:
            rule.pop()
        if not rule:
            break
        covered, precision = _precision(rule, x[left], bad[left])
        aside, precision_aside = _precision(rule, x[prune], bad[prune])
        if covered < MIN_COVER or precision < MIN_PRECISION or aside < 2 or precision_aside < MIN_PRECISION - 0.1:
            break
        found.rules.append(rule)
        left &= ~_covers(rule, x)
    return found


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DecisionList:
    """Learn from ``labels`` (doc_id, quality: 1 good, 0 bad) and the texts of ``docs`` (doc_id, text).

    Rows with a null doc_id or label are not used. Bad rows that the base rules reject anyway are left out, so the list
    learns what those rules miss.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    own = F.broadcast(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))  # at most ``rows`` rows
    stats = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(own, "doc_id").select("text", "quality"))
    sample = stats.where(~base_failed()).select("quality", *[feature(n).alias(n) for n in FEATURES]).orderBy(*FEATURES, "quality").limit(rows).toArrow()
    x = np.column_stack([sample.column(n).to_numpy() for n in FEATURES]) if sample.num_rows else np.zeros((0, len(FEATURES)))
    return learn(x, sample.column("quality").to_numpy() == 0)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with ``__stats``, ``__base_failed``, ``__rule`` (the rule that rejects, else null) and ``__kept``.

    Columns of these names are replaced. A null, empty or blank text has no words and fails the base rules; equal rows fare
    alike; an empty table gives an empty table.
    """
    out = with_statistics(docs.drop("__stats", "__base_failed", "__rule", "__kept")).withColumns({"__base_failed": base_failed(), "__rule": rules.rule()})
    return out.withColumn("__kept", ~F.col("__base_failed") & F.col("__rule").isNull())


def query(spark, sf_dir: str) -> DataFrame:
    """op8: statistics, base verdict and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.select("doc_id", *[F.col(f"__stats.{n}").alias(n) for n in COUNTS], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__rule").alias("rule"))
