"""SimHash near-dedup with covering locality-sensitive hashing.

A text's fingerprint has 64 bits: bit j is set if it is set in more than half of the XXH64 values (seed 42) of the
text's word shingles, repeats included. Two fingerprints link at ``RADIUS`` or fewer differing bits.

Links are found by covering masks: bit i of a fingerprint gets a nonzero vector m(i) of GF(2)^(RADIUS+1), and each of the
2^(RADIUS+1)-1 nonzero vectors v of that space gives a table whose key keeps the bits with <m(i), v> = 1. Any set of at
most RADIUS differing bits has a nonzero v orthogonal to all their m(i), since RADIUS linear conditions leave a line of
a (RADIUS+1)-dimensional space. So every pair within the radius shares its key in some table: no link can be lost.

Only distinct fingerprints enter the tables, so exact copies cost one row each. A bucket of up to ``BUCKET`` fingerprints
is searched breadth-first in numpy and emits a spanning forest, never its pairs. A larger bucket is resolved by
wildcards: two members differ in at most RADIUS of the bits that the mask drops, so for each choice of RADIUS such bits
its members are grouped by what remains, and all in a group are within the radius. That is linear in the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, boxed, column, keep, sorted_runs, text_keys, unboxed, utf8
from corpusloom.llm.components import connected_components

SHINGLE = 3
RADIUS = 3
BUCKET = 8192
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks of 64 bits, one for each nonzero vector; m(i) runs through all nonzero vectors in turn."""
    n = 1 << (radius + 1)
    vector = [i % (n - 1) + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, n)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned: words of the text with A-Z lowered, ``shingle`` words joined by a space.

    Fewer words: one shingle of them all. No word (null, empty or blank text): zero.
    """
    words = utf8(text).lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, fp: long) for every row; no shuffle. k1, k2 stand for the text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t) for t in column(batch, "text").to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "k1"), column(batch, "k2"), pa.array(fp)], ["doc_id", "k1", "k2", "fp"])

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_keys()), make, "doc_id long, k1 long, k2 long, fp long")


def _forest(fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges (member, root) that join the members of one bucket that are linked, directly or through others."""
    left = np.sort(fp)
    member, root = [], []
    while len(left) > 1:
        start, left, front = int(left[0]), left[1:], [left[0]]
        while front and len(left):
            near = np.bitwise_count((left ^ front.pop()).view(np.uint64)) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                front.extend(found)
                member.extend(found.tolist())
                root.extend([start] * len(found))
    return member, root


def _links_in_buckets(batches: Iterator[pa.RecordBatch], radius: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, x, y): kind 0 links fingerprints x and y, kind t > 0 hands on fingerprint x of a large bucket of table t with key y."""
    for table, whole in sorted_runs(batches, ["tab", "key"], bucket):
        tab, key, fp = (table.column(c).to_numpy() for c in ("tab", "key", "fp"))
        if not whole:
            yield pa.RecordBatch.from_arrays([pa.array(tab, pa.int32()), pa.array(fp), pa.array(key)], ["kind", "x", "y"])
            continue
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (tab[1:] != tab[:-1])) + 1
        bounds = np.concatenate(([0], cuts, [len(key)]))
        xs: list[int] = []
        ys: list[int] = []
        for at in np.flatnonzero(np.diff(bounds) > 1):
            x, y = _forest(fp[bounds[at] : bounds[at + 1]], radius)
            xs += x
            ys += y
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(xs), np.int32)), pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["kind", "x", "y"])


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) edges among distinct fingerprints (``fp`` long) whose components are those of all pairs within ``radius``."""
    table = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    keys = F.array(*[F.struct(F.lit(t + 1).alias("tab"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(table)])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.tab", "k.key", "fp")
    dealt = rows.repartition("tab", "key").sortWithinPartitions("tab", "key")
    found = keep(dealt.mapInArrow(lambda it: _links_in_buckets(it, radius, bucket), "kind int, x long, y long"), "links")
    links = found.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"))
    large = found.where("kind > 0")
    if large.isEmpty():
        return links
    for t, m in enumerate(masks(radius)):
        free = [i for i in range(64) if not m >> i & 1]
        wild = [~sum(1 << i for i in c) for c in combinations(free, radius)]
        member = large.where(F.col("kind") == t + 1).select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(len(wild) - 1))).alias("w"))
        choice = distinct.sparkSession.createDataFrame([(i, w) for i, w in enumerate(wild)], "w int, kept long")
        group = member.join(F.broadcast(choice), "w").withColumn("rest", F.col("x").bitwiseAND(F.col("kept")))
        least = group.groupBy("y", "w", "rest").agg(F.min("x").alias("a"), F.max("x").alias("top")).where("a <> top")
        links = links.unionByName(group.join(least, ["y", "w", "rest"]).where("a <> x").select("a", F.col("x").alias("b")).distinct())
    return links


def near_duplicate_classes(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, k1, k2, fp, root, component_id): one row for each row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links, the row's own included. Rows with a null doc_id are
    fingerprinted and linked like others and never are the smallest; a component of such rows only has a null
    component_id. root is the component's smallest fingerprint. Equal rows are kept as often as they come. An empty table
    gives an empty table.
    """
    rows = keep(fingerprints(docs), "fingerprints")
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(fingerprint_links(groups.select("fp"), radius, bucket))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(least, "root"), "fp")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` with all their columns, one for each component: that with the smallest doc_id.

    Of several rows with that doc_id the one whose text has the least keys stays; of equal rows, one. Rows of a
    component without any doc_id: the one with the least keys.
    """
    classes = keep(near_duplicate_classes(docs, radius), "classes")
    best = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k1", "k2")).alias("b"))
    chosen = best.select("b.doc_id", "b.k1", "b.k2").distinct()
    k1, k2 = text_keys()
    keyed = boxed(docs, "doc_id", "text").withColumns({"__k1": k1, "__k2": k2})
    best_keys = chosen.select(F.col("doc_id").alias("__id"), F.col("k1").alias("__a"), F.col("k2").alias("__b"))

    def is_chosen(doc_id, k1, k2):
        return doc_id.eqNullSafe(F.col("__id")) & (F.col(k1) == F.col("__a")) & (F.col(k2) == F.col("__b"))

    kept = keyed.join(best_keys, is_chosen(F.col("doc_id").cast("long"), "__k1", "__k2"), "left_semi")
    # copies of one text differ in doc_id, so they are counted, and then joined, apart
    repeated = classes.groupBy("doc_id", "k1", "k2").count().where("count > 1")
    many = repeated.join(best_keys, is_chosen(F.col("doc_id"), "k1", "k2"), "left_semi")
    if not many.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__k1", "__k2"])
    return unboxed(kept, docs.columns, ("doc_id", "text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: doc_id, fingerprint (16 hex digits), component_id over the whole table ``documents``."""
    classes = near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
