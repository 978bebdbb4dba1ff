"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a target of words. Among all rates r of its documents with sum(r * size) = target and 0 <= r <= 2, those
nearest to one copy each in relative entropy are the exponential tilts r = min(2, exp(lambda * size / mean size)). The one
lambda of a source is the root of the convex dual's gradient; it is found by Newton steps, kept inside a bracket, each of
which is one aggregation over all sources at once. Documents enter as counts by (source, size), for documents of one
source and size have one rate; a source with a third of all rows is thus no larger than its number of distinct sizes.

Rates become whole copies in two steps: running totals over a source's sizes are rounded, longest first, so that errors
cancel; then what is still missing or too much is settled, a few times, by the one size or pair of sizes that brings it nearest. Inside a (source,
size) cell the documents with the least hashes take the odd copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import WORD_PATTERN, boxed, cut, keep, small_side, text_keys, text_or_empty, unboxed

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Newton steps between two checks of convergence, checks at most, and the relative error that ends them.
STEPS, CHECKS, ACCURACY = 4, 12, 1e-9
#: Rounds of settling what rounding left over.
SETTLES = 5


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __key (its source, null apart from every string), __size and __hash."""
    return docs.withColumns(
        {
            "__key": F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))),
            "__size": F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("long"),
            "__hash": F.xxhash64(F.lit("mix"), "doc_id", *text_keys()),
        }
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(__key, source_size, docs, target) from (__key, __size, n).

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all words by weight; a target stops
    at ``most`` times its source's size and what it leaves is shared by the others, until none is above. This is the
    level L with sum(min(most * size, weight * L)) = the whole, found by one pass over sources in order of size / weight.
    """
    s = sizes.groupBy("__key").agg(F.sum(F.col("__size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    every = Window.orderBy((F.col("__key") == "").cast("int"), "__key")  # one row for each source
    turn = (F.row_number().over(every) - 1) % len(weights)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    s = s.withColumns({"__caps": F.sum("cap").over(order) - F.col("cap"), "__open": F.sum("w").over(whole) - F.sum("w").over(order) + F.col("w"), "__all": share * F.sum("source_size").over(whole)})
    level = (F.col("__all") - F.col("__caps")) / F.col("__open")  # if this source and those after it stay under their caps
    s = s.withColumn("__level", F.when(level * F.col("w") <= F.col("cap"), level))
    s = s.withColumn("__level", F.coalesce(F.max("__level").over(whole), F.lit(0.0)))
    return s.select("__key", "source_size", "docs", F.least("cap", F.col("w") * F.col("__level")).alias("target"))


def _rate(most: int = MOST) -> Column:
    """exp(lambda * size / mean size), at most ``most``; all of a source whose target is the most it can give."""
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.lit(30.0), F.col("lam") * F.col("__size") / F.col("mean")))))


def _newton(cells: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """One safeguarded Newton step for every source: G(lambda) = sum(n * size * rate) against the target."""
    x = F.col("__size") / F.col("mean")
    words = F.col("n") * F.col("__size") * _rate(most)
    g = cells.join(state, "__key").groupBy("__key").agg(F.sum(words).alias("g"), F.sum(F.when(_rate(most) < most, words * x).otherwise(0.0)).alias("d"))
    s = state.drop("g").join(g, "__key", "left")
    low = F.coalesce(F.col("g") < F.col("target"), F.lit(False))
    s = s.withColumns({"lo": F.when(low, F.greatest("lo", "lam")).otherwise(F.col("lo")), "hi": F.when(low, F.col("hi")).otherwise(F.least("hi", "lam"))})
    step = F.col("lam") + F.when(F.col("d") > 0, (F.col("target") - F.col("g")) / F.col("d"))
    wide = F.when(F.col("hi") >= 1e9, F.greatest(2 * F.col("lam"), F.col("lam") + 1)).when(F.col("lo") <= -1e9, F.least(2 * F.col("lam"), F.col("lam") - 1)).otherwise((F.col("lo") + F.col("hi")) / 2)
    # a step must stay inside the bracket and not run away; else the bracket is halved or widened
    good = (step > F.col("lo")) & (step < F.col("hi")) & (F.abs(step - F.col("lam")) <= 4 * (1 + F.abs("lam")))
    done = F.col("full") | (F.abs(F.col("g") - F.col("target")) <= ACCURACY * F.col("target"))
    return s.withColumn("lam", F.when(done, F.col("lam")).otherwise(F.when(good, step).otherwise(wide))).drop("d")


def solve(cells: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """(__key, ..., lam, mean, full): the tilt of every source. ``cells``: (__key, __size, n), kept; ``aims``: ``targets``."""
    state = aims.select(
        "*",
        F.greatest(F.lit(1e-9), F.col("source_size") / F.col("docs")).alias("mean"),
        (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"),
        F.lit(-1e9).alias("lo"),
        F.lit(1e9).alias("hi"),
        F.lit(None).cast("double").alias("g"),
    )
    state = cut(state)
    for _ in range(CHECKS):
        side = small_side(state)
        for _ in range(STEPS):
            side = _newton(cells, side, most)
        state = cut(side)
        off = state.where("not full").agg(F.max(F.abs(F.col("g") - F.col("target")) / F.greatest(F.lit(1.0), F.col("target")))).first()[0]
        if off is None or off <= ACCURACY:
            break
    return state.withColumn("lam", F.round("lam", 10)).drop("lo", "hi", "g")  # sums of doubles differ in the last bits from run to run


def _copies(cells: DataFrame, tilts: DataFrame, most: int) -> DataFrame:
    """``cells`` with their source's columns and k, the copies that a cell's documents take together."""
    c = cells.join(small_side(tilts), "__key")
    longest = Window.partitionBy("__key").orderBy(F.desc("__size"))  # one row for each distinct size
    total = F.sum(F.col("n") * _rate(most)).over(longest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = c.withColumn("__up", F.floor(total + 0.5)).withColumn("k", F.col("__up") - F.coalesce(F.lag("__up").over(longest), F.lit(0)))
    c = keep(c.withColumn("k", F.greatest(F.lit(0), F.least("k", most * F.col("n")))).drop("__up", "lam", "mean", "full"), "cells")
    for _ in range(SETTLES):
        pick = cut(_moves(c, most))
        if pick.isEmpty():
            break
        c = c.join(small_side(pick), ["__key", "__size"], "left").withColumn("k", F.col("k") + F.coalesce("move", F.lit(0))).drop("move")
    return c


def _moves(c: DataFrame, most: int) -> DataFrame:
    """(__key, __size, move): for each source the change of copies that brings it nearest to its target, if any does.

    Either one size gets or loses copies, or one size gets a copy and another loses one: the pair whose difference is
    nearest to what is missing, found by sorting sizes that may get one among those that may lose one, shifted by what is
    missing. Windows are over a source's distinct sizes.
    """
    left = c.groupBy("__key").agg((F.first("target") - F.sum(F.col("k") * F.col("__size"))).alias("left"))
    own = c.where("__size > 0").join(small_side(left), "__key")
    room = F.when(F.col("left") > 0, most * F.col("n") - F.col("k")).otherwise(F.col("k"))
    times = F.least(room, F.greatest(F.lit(1), F.round(F.abs("left") / F.col("__size")).cast("long")))
    single = own.where(room > 0).select("__key", "left", F.abs(F.abs("left") - times * F.col("__size")).alias("off"), F.array(F.struct("__size", (times * F.signum("left").cast("long")).alias("move"))).alias("moves"))
    gets = own.where(F.col("k") < most * F.col("n")).select("__key", "left", "__size", F.col("__size").cast("double").alias("at"), F.lit(None).cast("long").alias("gone"))
    gives = own.where("k > 0").select("__key", "left", "__size", (F.col("__size") + F.col("left")).alias("at"), F.col("__size").alias("gone"))
    order = Window.partitionBy("__key").orderBy("at")
    beside = [F.last("gone", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.first("gone", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))]
    pairs = gets.unionByName(gives).withColumn("gone2", F.array(*beside)).where("gone is null")
    pairs = pairs.withColumn("other", F.explode("gone2")).where("other is not null and other <> __size")
    both = F.array(F.struct("__size", F.lit(1).cast("long").alias("move")), F.struct(F.col("other").alias("__size"), F.lit(-1).cast("long").alias("move")))
    double = pairs.select("__key", "left", F.abs(F.col("left") - (F.col("__size") - F.col("other"))).alias("off"), both.alias("moves"))
    better = single.unionByName(double).where(F.col("off") < F.abs("left") - 1e-9)
    best = better.groupBy("__key").agg(F.min(F.struct("off", "moves")).alias("b"))
    return best.select("__key", F.explode("b.moves").alias("m")).select("__key", F.col("m.__size").alias("__size"), F.col("m.move").alias("move"))


def _odd_copies(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` with (each, top, edge): copies of every document, and the hashes that take one more.

    The odd copies of a cell go to its least hashes, in the order (top byte unsigned, hash). Hashes are counted by top
    byte; only in the one where the count is reached are they ranked, so a cell with a third of all rows is ranked in
    a 256th of it.
    """
    c = cells.withColumns({"each": F.floor(F.col("k") / F.col("n")), "odd": F.col("k") % F.col("n")})
    top = F.shiftrightunsigned(F.col("__hash"), 56)
    some = rows.withColumn("top", top).join(small_side(c.where("odd > 0").select("__key", "__size", "odd")), ["__key", "__size"])
    by_top = some.groupBy("__key", "__size", "top", "odd").agg(F.count(F.lit(1)).alias("m"))
    run = F.sum("m").over(Window.partitionBy("__key", "__size").orderBy("top").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = by_top.withColumn("run", run).where("run >= odd and run - m < odd").select("__key", "__size", "top", (F.col("odd") - F.col("run") + F.col("m")).alias("rank"))
    ranked = some.join(edge, ["__key", "__size", "top"]).withColumn("r", F.row_number().over(Window.partitionBy("__key", "__size").orderBy("__hash")))
    found = ranked.where("r = rank").select("__key", "__size", "top", F.col("__hash").alias("edge"))
    return c.join(found, ["__key", "__size"], "left").drop("k", "odd", "n")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows, cells): rows are (doc_id, __key, __size, __hash) of every document; cells say what each takes."""
    rows = keep(_keyed(docs.select("doc_id", "source", "text")).select("doc_id", "__key", "__size", "__hash"), "sizes")
    cells = keep(rows.groupBy("__key", "__size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    tilts = solve(cells, targets(cells, weights, share, most), most)
    return rows, keep(_odd_copies(rows, _copies(cells, tilts, most)), "copies")


def _with_copies(rows: DataFrame, cells: DataFrame) -> DataFrame:
    top = F.shiftrightunsigned(F.col("__hash"), 56)
    more = (top < F.col("top")) | (top == F.col("top")) & (F.col("__hash") <= F.col("edge"))
    return rows.join(small_side(cells), ["__key", "__size"]).withColumn("__copies", F.col("each") + F.coalesce(more, F.lit(False)).cast("int"))


def mixed_words(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    A null text has size 0 and takes nothing; a null source is a source of its own, the last; rows with equal doc_id and
    text take equally many copies. An empty table gives an empty table.
    """
    rows, cells = plan(docs, weights, share, most)
    return _with_copies(rows, cells).select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows of ``docs`` with all their columns, each as often as the mix takes it; nulls and ties as above.

    Documents without a word, which no target counts, stay as they are, once.
    """
    _, cells = plan(docs, weights, share, most)
    needed = ("doc_id", "source", "text")
    out = _with_copies(_keyed(boxed(docs, *needed)), cells.select("__key", "__size", "each", "top", "edge"))
    out = out.withColumn("__copies", F.when(F.col("__size") == 0, 1).otherwise(F.col("__copies")))
    out = out.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return unboxed(out, docs.columns, needed)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: what the mix takes of every document."""
    return mixed_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
