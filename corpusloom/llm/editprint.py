"""Document fingerprints by randomised edit embedding.

Every text walks over its characters by the same random rules: at step j, standing on character c, it writes c and moves
on if bit (j, c) of a shared random table is set (Chakraborty, Goldenberg, Koucky 2016). Two texts that are few edits
apart fall back into step soon after each edit, so edit distance turns into Hamming distance of what is written. The time
spent on a character is looked up in a table of the steps to the next set bit, so a walk takes one look a character.

A fingerprint samples the written string: at level k one position of every block of 2^k, the positions of level k+1
being a choice among those of level k, so that texts of different lengths are compared at the coarser of their levels. A
text takes the level that gives it ``SAMPLES`` to twice as many positions. A sample is a character's class, 1 to 15; 0
stands for "already ended". Likeness is the share of agreeing samples among positions that either text reaches.

Near-duplicate search bands sampled positions; what shares a bucket is verified by likeness, until links span all that is alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, column, cut, keep, small_batches, sorted_runs, text_keys, text_or_empty
from corpusloom.llm.components import connected_components

SAMPLES = 128
CLASSES = 64
#: Steps after which the shared random table repeats.
PERIOD = 1 << 14
SEED = 20_16
#: Bands of a fingerprint and samples in each.
BANDS, ROWS = 16, 6
SIMILARITY = 0.8
#: Bytes of text, about, in one range of ids.
RANGE_BYTES = 24 << 20
#: Ranges at most; beyond, they grow instead. A range is sorted with spilling and streamed, so its size doesn't bind memory.
MAX_RANGES = 2000


def _tables() -> list[bytes]:
    """For each class and step, how many steps a walk stays on a character of that class."""
    bits = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), np.uint8)
    bits[:, -1] = 1
    steps = np.zeros((CLASSES, PERIOD), np.uint8)
    steps[:, -1] = 1
    for j in range(PERIOD - 2, -1, -1):
        steps[:, j] = np.where(bits[:, j] == 1, 1, np.minimum(steps[:, j + 1] + 1, 255))
    return [row.tobytes() for row in steps]


class Embedder:
    """Walks and fingerprints; one for each task, for it holds the shared tables."""

    def __init__(self):
        self.steps = _tables()
        self.blocks: dict[int, np.ndarray] = {}

    @staticmethod
    def codes(text: str) -> np.ndarray:
        """Code points mixed to 32 bits."""
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        x = (x * np.uint32(0x9E3779B1)) ^ (x >> np.uint32(7))
        return x * np.uint32(0x85EBCA6B)

    def walk(self, codes: np.ndarray, start: int = 0) -> np.ndarray:
        """The step at which each character is left."""
        steps, last = self.steps, PERIOD - 1
        classes = (codes >> np.uint32(26)).astype(np.uint8).tobytes()  # 64 classes
        ends = accumulate(classes, lambda j, c: j + steps[c][j & last], initial=start)
        next(ends)
        return np.fromiter(ends, np.int64, len(codes))

    def positions(self, level: int, n: int) -> np.ndarray:
        """The sampled position of each of the first ``n`` blocks of 2^level steps."""
        at = np.arange(n, dtype=np.int64)
        for k in range(level, 0, -1):
            at = 2 * at + _choice(k, at)
        return at

    def fingerprint(self, codes: np.ndarray, ends: np.ndarray) -> str:
        if not len(codes):
            return "00"
        length = int(ends[-1])
        level = max(0, (length // SAMPLES).bit_length() - 1)
        at = self.positions(level, (length + (1 << level) - 1) >> level)
        inside = at < length
        char = np.searchsorted(ends, np.where(inside, at, 0), side="right")
        symbol = np.where(inside, (codes[char] >> np.uint32(12)) % np.uint32(15) + 1, 0)
        return f"{level:02x}" + symbol.astype(np.uint8).tobytes().hex()[1::2]


def _choice(level: int, block: np.ndarray) -> np.ndarray:
    """Which of the two samples of level-1 a block of ``level`` takes: a shared random bit."""
    x = block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(1)).astype(np.int64)


@lru_cache(1 << 12)
def samples(fingerprint: str) -> tuple[int, np.ndarray]:
    return int(fingerprint[:2], 16), np.frombuffer(bytes.fromhex("0" + "0".join(fingerprint[2:])) if len(fingerprint) > 2 else b"", np.uint8)


def coarser(level: int, x: np.ndarray, to: int) -> np.ndarray:
    """Samples of ``level`` brought to a coarser level."""
    while level < to:
        level += 1
        at = np.arange((len(x) + 1) // 2, dtype=np.int64)
        x = np.append(x, np.uint8(0))[np.minimum(2 * at + _choice(level, at), len(x))]
    return x


def likeness(a: str, b: str) -> float:
    """0 to 1; equal fingerprints (two empty texts included) are 1 alike."""
    if a == b:
        return 1.0
    (la, x), (lb, y) = samples(a), samples(b)
    level, n = max(la, lb), 0
    x, y = coarser(la, x, level), coarser(lb, y, level)
    n = max(len(x), len(y))
    x, y = np.pad(x, (0, n - len(x))), np.pad(y, (0, n - len(y)))
    reached = (x > 0) | (y > 0)
    return float(((x == y) & reached).sum() / reached.sum()) if reached.any() else 0.0


def band_keys(fingerprint: str) -> list[int]:
    """Keys of the bands at the text's own level and the next, so that lengths near a change of level still meet.

    A band takes ``ROWS`` samples out of all that the text has at that level, at the same places whether the level is the
    text's own or not, for both give the same samples.
    """
    level, x = samples(fingerprint)
    keys = []
    for own, s in ((level, x), (level + 1, coarser(level, x, level + 1))):
        taken = np.append(s, np.uint8(0))[_places(len(s))].tobytes()
        keys += [xxhash.xxh64_intdigest(b"%d:%d:" % (own, b) + taken[b * ROWS : (b + 1) * ROWS]) - (1 << 63) for b in range(BANDS)]
    return keys


@lru_cache
def _orders() -> np.ndarray:
    """For each sample of the bands, one band after the other, an order of all places that a fingerprint can have."""
    return np.random.default_rng(SEED + SAMPLES).permuted(np.tile(np.arange(2 * SAMPLES), (BANDS * ROWS, 1)), axis=1)


@lru_cache(None)
def _places(n: int) -> np.ndarray:
    """Places of the bands' samples among ``n``: of each order the first under n, so that nearly equal n have nearly all in common."""
    orders = _orders()
    return orders[np.arange(len(orders)), (orders < max(1, n)).argmax(1)]


def _join(groups: list[list[tuple[int, str]]], node: int, print_: str, similarity: float) -> list[int]:
    """Put a member into the groups of those linked so far; the nodes to link it to, one of each group that holds one alike."""
    to, rest, own = [], [], [(node, print_)]
    for group in groups:
        hit = next((n for n, p in group if likeness(p, print_) >= similarity), None)
        if hit is None:
            rest.append(group)
        else:
            to.append(hit)
            own, less = (own, group) if len(own) > len(group) else (group, own)
            own += less
    groups[:] = [*rest, own]
    return to


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, fingerprint) of every row of ``docs`` (doc_id, text); no shuffle. Null texts are empty."""

    def make():
        e = Embedder()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t in column(batch, "text").to_pylist():
                codes = e.codes(t or "")
                out.append(e.fingerprint(codes, e.walk(codes)))
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "k1"), column(batch, "k2"), pa.array(out)], ["doc_id", "k1", "k2", "fingerprint"])

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_keys()), make, "doc_id long, k1 long, k2 long, fingerprint string")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, fingerprint, class_id): class_id is the smallest doc_id that verified links reach.

    In a bucket of one band every fingerprint is compared with those before it and links to one of each group that holds
    one ``similarity`` alike, which joins these groups: a spanning forest of all links inside the bucket, so it emits
    fewer links than members. Null doc_ids are never the smallest. An empty table gives an empty table.
    """
    rows = keep(fingerprints(docs), "edit-prints")
    groups = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).withColumn("node", F.xxhash64("fingerprint"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, nodes = column(b, "fingerprint").to_pylist(), column(b, "node").to_pylist()
            out = [(k, n, p) for p, n in zip(prints, nodes, strict=True) for k in dict.fromkeys(band_keys(p))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "node", "fingerprint"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, forest = None, []
        for table, _ in sorted_runs(batches, ["key"], 10_000):
            a, b = [], []
            for key, node, print_ in zip(*(table.column(c).to_pylist() for c in ("key", "node", "fingerprint")), strict=True):
                if key != last:
                    last, forest = key, []
                to = _join(forest, node, print_, similarity)
                a += [node] * len(to)
                b += to
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    bands = groups.select("fingerprint", "node").mapInArrow(keyed, "key long, node long, fingerprint string")
    links = bands.repartition("key").sortWithinPartitions("key", "fingerprint").mapInArrow(linked, "a long, b long")
    roots = connected_components(cut(links.distinct()))
    rooted = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    return rows.join(rooted.join(least, "root").select("fingerprint", "class_id"), "fingerprint").select("doc_id", "fingerprint", "class_id")


NEIGHBOURS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "band_edited boolean, band_next boolean"
)


def against_next(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) against its edited text and the next row's text.

    Rows are ordered by doc_id (nulls last), then text; the row after the last is the first. A row's edited text has its
    last floor(n / 2) code points replaced by the first as many (or all) of the next row's text. Null texts are empty.
    Rows are dealt into ranges of ids once; each range also gets the first row of the next range, so a range is walked
    alone. A table of one row is its own next; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total, n = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if not n:
        return docs.sparkSession.createDataFrame([], NEIGHBOURS)
    parts = min(MAX_RANGES, max(1, -(-total // RANGE_BYTES)))
    ids = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10 * MAX_RANGES)).first()[0] if parts > 1 else None
    bounds = sorted(set(ids or []))
    place = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(_range_of(F.col("doc_id"), bounds, 0))
    placed = rows.withColumn("part", place.cast("int"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text")
    firsts = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id")).alias("f"))
    filled = sorted((r["part"], r["f"]["doc_id"]) for r in firsts.collect())  # one row for each range
    before = {filled[i][0]: filled[i - 1][0] for i in range(len(filled))}
    heads = placed.where(F.coalesce(F.col("doc_id").isin([f for _, f in filled if f is not None]), F.lit(False)) | F.col("doc_id").isNull() & F.lit(any(f is None for _, f in filled)))
    head = heads.groupBy("part").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("doc_id"), F.col("o.text").alias("text"), "part")
    follow = head.select("doc_id", "text", F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")).alias("part"), F.lit(True).alias("extra"))
    dealt = placed.withColumn("extra", F.lit(False)).unionByName(follow)
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "extra", F.col("doc_id").isNull(), "doc_id", "text")
    return dealt.mapInArrow(_walk_ranges, NEIGHBOURS)


def _range_of(x: Column, bounds: list[int], first: int) -> Column:
    """The number of bounds at or under x, by binary search."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(x < bounds[middle], _range_of(x, bounds[:middle], first)).otherwise(_range_of(x, bounds[middle + 1 :], first + middle + 1))


def _walk_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e = Embedder()
    out: list[tuple] = []
    last = None  # (part, doc_id, text, codes, ends, print)
    for batch in batches:
        for part, extra, doc, text in zip(*(column(batch, c).to_pylist() for c in ("part", "extra", "doc_id", "text")), strict=True):
            codes = e.codes(text)
            ends = e.walk(codes)
            own = e.fingerprint(codes, ends)
            if last is not None and last[0] == part:
                out.append(_compare(e, last, text, codes, own))
            last = None if extra else (part, doc, text, codes, ends, own)
        if out:
            yield _neighbour_batch(out)
            out = []


def _compare(e: Embedder, last: tuple, next_text: str, next_codes: np.ndarray, next_print: str) -> tuple:
    _, doc, text, codes, ends, own = last
    half = len(text) // 2
    head = len(text) - half
    edited = text[:head] + next_text[:half]
    start = int(ends[head - 1]) if head else 0
    edited_ends = np.concatenate([ends[:head], e.walk(next_codes[:half], start)])
    edited_print = e.fingerprint(np.concatenate([codes[:head], next_codes[:half]]), edited_ends)
    keys = set(band_keys(own))
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc, len(text), digest, own, edited_print, likeness(own, edited_print), likeness(own, next_print), not keys.isdisjoint(band_keys(edited_print)), not keys.isdisjoint(band_keys(next_print)))


def _neighbour_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in NEIGHBOURS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document against its edited text and the next document."""
    return against_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
