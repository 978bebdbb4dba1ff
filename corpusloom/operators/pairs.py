"""All pairs of two sets of vectors, block by block: exact, distributed, and bounded in memory.

Both sides are dealt into blocks; a cell of the grid of blocks is one group of a cogroup. Inside a cell a matrix product in
single precision shows which pairs may count, with a bound on its error; only these are computed in double precision, in
the order of the vectors' elements, as ``search.cosine`` computes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most (about; rows are dealt by hash), and at least where there are cores to spare.
BLOCK, LEAST_BLOCK = 16_384, 512
#: Elements of a piece of the score matrix.
PIECE = 1 << 22
#: Scores that differ by less may be equal to nine digits.
TIE = 2e-9


def blocks_of(n: int, others: int, cells: int) -> int:
    """Blocks for ``n`` rows against ``others`` blocks, so that there are ``cells`` cells if the rows suffice."""
    return max(1, -(-n // BLOCK), min(-(-cells // others), n // LEAST_BLOCK))


def _dealt(rows: DataFrame, key: str, own: str, blocks: int, other: str, others) -> DataFrame:
    return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(other, F.explode(others))


def cells(a: DataFrame, b: DataFrame, a_key: str, b_key: str, step: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``step(block of a, block of b)`` for all blocks; every pair of rows meets in one cell."""
    sc = a.sparkSession.sparkContext
    n, m = a.select(F.count(F.lit(1))).first()[0], b.select(F.count(F.lit(1))).first()[0]
    cols = max(1, -(-m // BLOCK))
    rows = blocks_of(n, cols, 3 * sc.defaultParallelism)
    left = _dealt(a, a_key, "__i", rows, "__j", F.sequence(F.lit(0), F.lit(cols - 1)))
    right = _dealt(b, b_key, "__j", cols, "__i", F.sequence(F.lit(0), F.lit(rows - 1)))
    return _cogrouped(left, right, rows * cols, lambda key, x, y: step(x, y), schema)


def own_cells(a: DataFrame, key: str, step: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str) -> DataFrame:
    """``step(block, other block)`` for all two blocks of one table, and ``step(block, None)`` for each by itself."""
    sc = a.sparkSession.sparkContext
    n = a.select(F.count(F.lit(1))).first()[0]
    k = max(1, -(-n // BLOCK), min(int(np.ceil((6 * sc.defaultParallelism) ** 0.5)), n // LEAST_BLOCK))
    dealt = a.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))
    left = dealt.withColumn("__i", F.col("__b")).withColumn("__j", F.explode(F.sequence("__b", F.lit(k - 1)))).drop("__b")
    right = dealt.withColumn("__j", F.col("__b")).where("__b > 0").withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__b") - 1))).drop("__b")
    return _cogrouped(left, right, k * (k + 1) // 2, lambda cell, x, y: step(x, None if cell[0].as_py() == cell[1].as_py() else y), schema)


def _cogrouped(left: DataFrame, right: DataFrame, count: int, step, schema: str) -> DataFrame:
    parts = max(1, min(count, 2000))
    names = right.columns
    deal = lambda df, *cell: df.repartition(parts, *cell).groupBy(*cell)

    def run(key, x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.rename_columns(names)
        return step(key, x.drop_columns(["__i", "__j"]), y.drop_columns(["__i", "__j"]))

    other = right.select(*[F.col(c).alias(f"__other_{c}") for c in names])  # both sides may come from one table: other names keep them apart
    return deal(left, "__i", "__j").cogroup(deal(other, "__other___i", "__other___j")).applyInArrow(run, schema)


# --- inside a cell


class Vectors:
    """Vectors of one length: their places in the table, elements by column in double precision, norms, unit vectors in single."""

    def __init__(self, at: np.ndarray, values: np.ndarray) -> None:
        self.at, self.by_element = at, np.ascontiguousarray(values.T, np.float64)
        total = np.zeros(len(at))
        for x in self.by_element:
            total += x * x
        self.norms = np.sqrt(total)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = np.nan_to_num(self.by_element.T / self.norms[:, None], nan=0.0).astype(np.float32)
        self.odd = ~np.isfinite(self.norms)

    def __len__(self) -> int:
        return len(self.at)


def by_length(table: pa.Table, name: str) -> dict[int, Vectors]:
    """The vectors by their length; those that are null or hold nulls are left out: their cosine is null."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # without rows
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    holed = np.zeros(len(column), bool)
    if column.flatten().null_count:
        parents, gaps = pc.list_parent_indices(column).to_numpy(), pc.is_null(column.flatten()).to_numpy(zero_copy_only=False)
        holed[parents[gaps]] = True
    out = {}
    for size in np.unique(sizes[(sizes >= 0) & ~holed]):
        at = np.flatnonzero((sizes == size) & ~holed)
        own = column if len(at) == len(column) else column.take(pa.array(at))
        out[int(size)] = Vectors(at, own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(size)))
    return out


def cosines(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """``search.cosine`` of the pairs (i, j), the elements added up one after the other."""
    out = np.empty(len(i))
    for s in range(0, len(i), PIECE):
        own, other = i[s : s + PIECE], j[s : s + PIECE]
        total = np.zeros(len(own))
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            for x, y in zip(a.by_element, b.by_element, strict=True):
                total += x[own] * y[other]
            size = a.norms[own] * b.norms[other]
            out[s : s + PIECE] = np.where(size < 1e-12, 0.0, total / size)
    return out


def products(a: Vectors, b: Vectors) -> Iterator[tuple[int, np.ndarray, float]]:
    """(first row, piece, error): approximate cosines of some rows of ``a`` to all of ``b``, in pieces of bounded size.
    NaN comes where a vector is not finite."""
    error = (a.by_element.shape[0] + 16) * 2.0**-23
    tiny = len(a) and len(b) and np.nanmin(a.norms) * np.nanmin(b.norms) < 1e-12
    step = max(1, PIECE // max(1, len(b)))
    for s in range(0, len(a), step):
        piece = a.unit[s : s + step] @ b.unit.T
        if tiny:
            piece[a.norms[s : s + step, None] * b.norms[None, :] < 1e-12] = 0
        if a.odd.any() or b.odd.any():
            piece[a.odd[s : s + step]] = np.nan
            piece[:, b.odd] = np.nan
        yield s, piece, error


def _nth_best(run: np.ndarray, score: np.ndarray, k: int, rows: int) -> np.ndarray:
    """Of scores sorted best first within rows: each row's k-th, minus infinity where there are fewer."""
    first = np.searchsorted(run, np.arange(rows))
    last = first + k - 1
    held = last < np.searchsorted(run, np.arange(rows), side="right")
    return np.where(held, score[np.minimum(last, max(0, len(score) - 1))] if len(score) else -np.inf, -np.inf)


def _rank_within(same: np.ndarray) -> np.ndarray:
    """Places within runs; ``same`` says that a row belongs to the run of the row before."""
    at = np.arange(len(same))
    return at - np.maximum.accumulate(np.where(same, 0, at)) if len(same) else at


def best_in_cell(index: pa.Table, queries: pa.Table, k: int, vector: str, key: str, query: str = "query_vector") -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """(query, row, score, index by key): all pairs that may be among the k best of a query, ties by key. NaN is the best
    score, and a null one, here NaN with row < 0 (row -1 - r), the worst."""
    index = index.take(pc.sort_indices(index.column(key), sort_keys=[(key, "ascending")], null_placement="at_start")) if index.num_rows else index
    own, asked = by_length(index, vector), by_length(queries, query)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left = np.ones(queries.num_rows, bool)
    for size, q in asked.items():
        left[q.at] = False
        v = own.get(size)
        rest = np.ones(index.num_rows, bool)
        if v is not None:
            rest[v.at] = False
            for s, piece, error in products(q, v):
                np.nan_to_num(piece, copy=False, nan=np.inf)
                if piece.shape[1] > k:
                    kth = np.partition(piece, piece.shape[1] - k, axis=1)[:, piece.shape[1] - k]
                    r, c = np.nonzero(piece >= kth[:, None] - np.float32(2 * error + TIE))
                else:
                    r, c = (x.ravel() for x in np.indices(piece.shape))
                score = cosines(q, r + s, v, c)
                rank = np.where(np.isnan(score), np.inf, score)
                order = np.lexsort((c, -rank, r))
                r, c, score, rank = r[order], c[order], score[order], rank[order]
                same = np.zeros(len(r), bool)
                same[1:] = (r[1:] == r[:-1]) & (rank[1:] == rank[:-1])
                held = (rank >= _nth_best(r, rank, k, piece.shape[0])[r] - TIE) & (_rank_within(same) < k)
                out.append((q.at[r[held] + s], v.at[c[held]], score[held]))
        for at in _without(q.at, np.flatnonzero(rest)[:k]):
            out.append(at)
    for at in _without(np.flatnonzero(left), np.arange(index.num_rows)[:k]):
        out.append(at)
    parts = list(zip(*out, strict=True)) if out else [[], [], []]
    q, r, s = (np.concatenate(p) if len(p) else np.zeros(0, t) for p, t in zip(parts, (np.int64, np.int64, float), strict=True))
    return q, r, s, index


def _without(asked: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if len(asked) and len(rows):
        yield np.repeat(asked, len(rows)), -1 - np.tile(rows, len(asked)), np.full(len(asked) * len(rows), np.nan)


def over_in_cell(a: Vectors, b: Vectors, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of the pairs with a cosine over ``threshold``; NaN is over it."""
    for s, piece, error in products(a, b):
        i, j = np.nonzero(~(piece <= np.float32(threshold - 2 * error)))
        score = cosines(a, i + s, b, j)
        held = ~(score <= threshold)
        yield i[held] + s, j[held], score[held]


def counts_in_cell(a: Vectors, b: Vectors, thresholds: tuple[float, ...]) -> np.ndarray:
    """For each vector of ``a`` and each threshold how many of ``b`` have a greater cosine; NaN is greater."""
    out = np.zeros((len(a), len(thresholds)), np.int64)
    for s, piece, error in products(a, b):
        for t, threshold in enumerate(thresholds):
            low, high = np.float32(threshold - 2 * error), np.float32(threshold + 2 * error)
            out[s : s + len(piece), t] += (~(piece <= high)).sum(axis=1)
            i, j = np.nonzero((piece > low) & (piece <= high))
            if len(i):
                np.add.at(out[:, t], (i + s)[~(cosines(a, i + s, b, j) <= threshold)], 1)
    return out
