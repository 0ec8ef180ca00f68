"""Block matrices: dense tiles keyed by block row and column, multiplied tile by tile.

A tile is one row: ``bi, bj``, the rows and columns of the block that hold
cells (``rows``, ``cols``, local numbers) and their values as bytes, row by
row; absent cells count as zeros. A product moves tiles, never products of
cells: the pair (bi, k), (k, bj) meets once, each task sums what it has for a
tile of the result, and the partial tiles are summed as they stream in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ingress import materialised

#: Rows and columns of a full tile: 512 KB of doubles.
SIDE = 256
TILE = "bi long, bj long, rows array<int>, cols array<int>, vals binary"
CELL = "i long, j long, v double"


def _row(bi: int, bj: int, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
    lists = [pa.array([x.astype(np.int32).tolist()], pa.list_(pa.int32())) for x in (rows, cols)]
    return pa.RecordBatch.from_arrays([pa.array([bi], pa.int64()), pa.array([bj], pa.int64()), *lists, pa.array([np.ascontiguousarray(vals, np.float64).tobytes()], pa.binary())], ["bi", "bj", "rows", "cols", "vals"])


def _read(b: pa.RecordBatch, r: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a tile whose three columns begin at ``first``."""
    rows, cols = (b.column(first + k)[r].values.to_numpy(zero_copy_only=False) for k in (0, 1))
    return rows, cols, np.frombuffer(b.column(first + 2)[r].as_buffer(), np.float64).reshape(len(rows), len(cols))


def _packed(side: int):
    """The cells of one block to its tile; a cell given twice counts as the sum."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j, v = (table.column(n).to_numpy() for n in ("i", "j", "v"))
        rows, at_i = np.unique(i % side, return_inverse=True)
        cols, at_j = np.unique(j % side, return_inverse=True)
        vals = np.zeros((len(rows), len(cols)))
        np.add.at(vals, (at_i, at_j), v)
        return pa.Table.from_batches([_row(key[0].as_py(), key[1].as_py(), rows, cols, vals)])

    return run


def tiles(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """Cells ``i, j, v`` (indices from 0) as tiles; cells that are null anywhere are left out."""
    known = cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).dropna()
    return known.groupBy(F.expr(f"i div {side}").alias("bi"), F.expr(f"j div {side}").alias("bj")).applyInArrow(_packed(side), TILE)


def _cut_rows(side: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        i = table.column("i").to_numpy() % side
        vals = table.column("vals").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1)
        order = np.argsort(i, kind="stable")
        vals, i = vals[order], i[order]
        width = vals.shape[1]
        return pa.Table.from_batches([_row(block, a // side, i, np.arange(min(side, width - a)), vals[:, a : a + side]) for a in range(0, width, side)])

    return run


def row_tiles(df: DataFrame, row: str, values: str, side: int = SIDE) -> DataFrame:
    """The same from one array for each row, all of one length and without nulls: rows move once, as arrays."""
    arrays = df.select(F.col(row).cast("long").alias("i"), F.col(values).cast("array<double>").alias("vals"))
    return arrays.groupBy(F.expr(f"i div {side}").alias("bi")).applyInArrow(_cut_rows(side), TILE)


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(len(b)):
            rows, cols, vals = _read(b, r, 2)
            yield _row(b.column(1)[r].as_py(), b.column(0)[r].as_py(), cols, rows, vals.T)


def transposed(a: DataFrame) -> DataFrame:
    """Each tile is turned where it lies."""
    return a.mapInArrow(_turned, TILE)


def _placed(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, into_rows: np.ndarray, into_cols: np.ndarray) -> np.ndarray:
    out = np.zeros((len(into_rows), len(into_cols)))
    out[np.ix_(np.searchsorted(into_rows, rows), np.searchsorted(into_cols, cols))] = vals
    return out


class _Sum:
    """Tiles of one place summed."""

    def __init__(self) -> None:
        self.key, self.tile = None, None

    def add(self, key: tuple[int, int], rows: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> Iterator[pa.RecordBatch]:
        if key != self.key:
            yield from self.close()
            self.key, self.tile = key, (rows, cols, vals)
            return
        old_rows, old_cols, old = self.tile
        if np.array_equal(rows, old_rows) and np.array_equal(cols, old_cols):
            self.tile = rows, cols, old + vals
            return
        all_rows, all_cols = np.union1d(rows, old_rows), np.union1d(cols, old_cols)
        self.tile = all_rows, all_cols, _placed(*self.tile, all_rows, all_cols) + _placed(rows, cols, vals, all_rows, all_cols)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            yield _row(*self.key, *self.tile)
        self.key = None


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of tiles (bi, bj, a's three, b's three) to partial tiles of the result, in order of (bi, bj)."""
    done = _Sum()
    for b in batches:
        for r in range(len(b)):
            rows, ka, x = _read(b, r, 2)
            kb, cols, y = _read(b, r, 5)
            if not np.array_equal(ka, kb):
                _, at_a, at_b = np.intersect1d(ka, kb, return_indices=True)
                x, y = x[:, at_a], y[at_b]
            if x.shape[1]:
                yield from done.add((b.column(0)[r].as_py(), b.column(1)[r].as_py()), rows, cols, x @ y)
    yield from done.close()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = _Sum()
    for b in batches:
        for r in range(len(b)):
            yield from done.add((b.column(0)[r].as_py(), b.column(1)[r].as_py()), *_read(b, r, 2))
    yield from done.close()


def summed(parts: DataFrame) -> DataFrame:
    """Tiles of one place added up, one after the other: no task holds more than one."""
    return parts.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_summed, TILE)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two tiled matrices of one side.

    A tile of ``a`` goes to each block column of ``b`` that it meets and a tile
    of ``b`` to each block row of ``a``, so pairs spread over all tasks also
    where one block of the inner index holds everything. Indices alone say who
    meets whom.
    """
    a, b = materialised(a), materialised(b)
    left = a.select("bi", F.col("bj").alias("k"), *[F.col(c).alias(f"a_{c}") for c in ("rows", "cols", "vals")])
    right = b.select(F.col("bi").alias("k"), "bj", *[F.col(c).alias(f"b_{c}") for c in ("rows", "cols", "vals")])
    left, right = left.join(right.select("k", "bj").distinct(), "k"), right.join(left.select("k", "bi").distinct(), "k")
    pairs = left.hint("merge").join(right, ["bi", "bj", "k"]).sortWithinPartitions("bi", "bj")
    parts = pairs.select("bi", "bj", "a_rows", "a_cols", "a_vals", "b_rows", "b_cols", "b_vals").mapInArrow(_multiplied, TILE)
    return summed(parts)


def _scaled(factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                rows, cols, vals = _read(b, r, 2)
                yield _row(b.column(0)[r].as_py(), b.column(1)[r].as_py(), rows, cols, vals * factor)

    return run


def scaled(a: DataFrame, factor: float) -> DataFrame:
    return a if factor == 1.0 else a.mapInArrow(_scaled(float(factor)), TILE)


def _spread(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                rows, cols, vals = _read(b, r, 2)
                i, j = b.column(0)[r].as_py() * side + rows.astype(np.int64), b.column(1)[r].as_py() * side + cols.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(vals.ravel())], ["i", "j", "v"])

    return run


def cells_of(a: DataFrame, side: int = SIDE) -> DataFrame:
    """``i, j, v`` of all rows and columns that tiles hold."""
    return a.mapInArrow(_spread(side), CELL)
