"""What the operators of this subpackage share: words, keys of texts, tables kept between jobs, streamed runs.

Nulls: a null text counts as the empty text everywhere in this subpackage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word in Java's and RE2's syntax: whatever lies between ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8; ``bytes.split`` cuts at exactly these six bytes."""
    return utf8(text).split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_keys(name: str = "text") -> list[Column]:
    """Two independent 64-bit hashes of a text, k1 and k2: together they stand for the text where it need not travel."""
    return [F.xxhash64(text_or_empty(name)).alias("k1"), F.xxhash64(F.lit("second"), text_or_empty(name)).alias("k2")]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one on a single
    machine (tests), and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="corpusloom-")
        shared_folder.own = base
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table inside an iteration."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows up to which a side is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count shows it has at most ``rows`` rows; for kept (already computed) tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of an Arrow batch: Spark's default of 10,000 rows of text would hold tens of MB on either side of each task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, unless its owner has set another size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with state for each task: ``make()`` is called once a task and gives the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def boxed(docs: DataFrame, *needed: str) -> DataFrame:
    """``needed`` columns of ``docs`` and all others inside one struct, ``__row``, so that no name of theirs can clash."""
    others = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(1).alias("none")]).alias("__row"))


def unboxed(rows: DataFrame, columns: list[str], needed: tuple[str, ...]) -> DataFrame:
    """Back to ``columns``, in their order."""
    return rows.select(*[F.col(c) if c in needed else F.col("__row").getField(c).alias(c) for c in columns])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: Bits of the filters below, as powers of two: 2^28 bits are 32 MB, whatever the input's size.
LEAST_BITS, FILTER_BITS = 20, 28


def bits_for(keys: int) -> int:
    """Bits for so many keys: 16 to 32 for each, up to the bound; beyond it the filter lets more through."""
    return min(FILTER_BITS, max(LEAST_BITS, (16 * keys).bit_length()))


def key_filter(keys: DataFrame, name: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``2^bits`` bits with the bit of every key (a long column) set, built by Spark.

    Its size is bounded, so it may be broadcast at any scale. A clear bit proves that a key is absent; a set bit proves
    nothing, so what passes must still be joined exactly. More keys mean more rows in that join, never other results.
    """
    slot = F.shiftrightunsigned(F.col(name), 64 - bits)
    rows = (
        keys.select(F.shiftright(slot, 5).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int")).alias("b"))
        .groupBy("i")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[rows.column("i").to_numpy()] = rows.column("b").to_numpy().astype(np.uint64).astype(np.uint32)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) >> np.uint64(64 - 5 - (len(bits).bit_length() - 1))
    return (bits[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Cut a stream sorted by ``keys`` into tables that never divide a run of equal keys, unless the run exceeds ``limit`` rows.

    Yields (table, whole): a table that is not whole is a part of one longer run, and so are those that follow it up to
    and with the part that starts with another key. No more than ``limit`` rows of one run are held at once.
    """
    rest: pa.Table | None = None
    long_key: tuple | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        n = table.num_rows
        if n == 0:
            continue
        cols = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if long_key is not None:
            other = np.flatnonzero(change)
            end = n if tuple(c[0] for c in cols) == long_key and not len(other) else (other[0] if tuple(c[0] for c in cols) == long_key else 0)
            if end:
                yield table.slice(0, end), False
            if end == n:
                rest = None
                continue
            long_key = None
            table, change, n = table.slice(end), change[end:], n - end
            cols = [c[end:] for c in cols]
            change[0] = False
        starts = np.flatnonzero(change)
        last = starts[-1] if len(starts) else 0
        if last:
            yield table.slice(0, last), True
        rest = table.slice(last)
        if rest.num_rows > limit:
            long_key = tuple(c[last] for c in cols)
            yield rest, False
            rest = None
    if rest is not None and rest.num_rows:
        yield rest, True
