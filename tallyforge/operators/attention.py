"""Attention in one pass over tiles: no score is ever a row.

A tile of queries meets tiles of keys and values one after the other and keeps
for each query a running state: the largest score, the sum of exponents and
the weighted sum of values, both relative to it. States of different tasks
merge the same way, so neither side has to fit in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ingress import materialised

#: Rows of a tile, and tiles of keys that a task takes for one of queries.
ROWS, MEET = 2048, 8
_STATE = "own long, ids binary, top binary, norm binary, acc binary"


def _packed(names: tuple[str, ...]):
    """Rows of a block as one: numbers and arrays as bytes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        parts = []
        for n in names:
            c = table.column(n).combine_chunks()
            c = c.flatten() if pa.types.is_list(c.type) else c
            parts.append(pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *parts], ["block", *names])

    return run


def _tiled(df: DataFrame, names: tuple[str, ...], by: str) -> tuple[DataFrame, int]:
    """``block`` and ``names`` as bytes, and how many blocks there are: of about ``ROWS`` rows, whatever their numbers."""
    df = materialised(df)
    n = math.ceil(df.count() / ROWS)
    kind = ", ".join(f"{x} binary" for x in names)
    return df.groupBy(F.pmod(F.xxhash64(by), F.lit(max(n, 1))).alias("block")).applyInArrow(_packed(names), f"block long, {kind}"), n


def _merge(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    top = np.maximum(a[0], b[0])
    x, y = np.exp(a[0] - top), np.exp(b[0] - top)
    return top, a[1] * x + b[1] * y, a[2] * x[:, None] + b[2] * y[:, None]


def _states(scale: float):
    """Rows (own, keyed, x, y), a tile of queries before the tiles of keys and values that it meets, to states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ids = q = state = None

        def close() -> Iterator[pa.RecordBatch]:
            if state is not None:
                parts = [np.ascontiguousarray(x).tobytes() for x in state]
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), *[pa.array([p], pa.binary()) for p in (ids, *parts)]], ["own", "ids", "top", "norm", "acc"])

        for b in batches:
            for r in range(len(b)):
                x, y = (b.column(k)[r].as_py() for k in (2, 3))
                if not b.column(1)[r].as_py():
                    yield from close()
                    own, ids, state = b.column(0)[r].as_py(), y, None
                    q = np.frombuffer(x).reshape(len(ids) // 8, -1) * scale
                    continue
                k = np.frombuffer(x).reshape(-1, q.shape[1])
                v = np.frombuffer(y).reshape(len(k), -1)
                scores = q @ k.T
                top = scores.max(axis=1)
                weights = np.exp(scores - top[:, None])
                part = top, weights.sum(axis=1), weights @ v
                state = part if state is None else _merge(state, part)
        yield from close()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States in order of ``own`` to rows ``i, vals``."""
    own = ids = state = None

    def close() -> Iterator[pa.RecordBatch]:
        if state is not None:
            vals = state[2] / state[1][:, None]
            ends = pa.array(np.arange(0, vals.size + 1, vals.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.ListArray.from_arrays(ends, pa.array(vals.ravel()))], ["i", "vals"])

    for b in batches:
        for r in range(len(b)):
            key, own_ids, *parts = (c[r].as_py() for c in b.columns)
            top, norm, acc = (np.frombuffer(p) for p in parts)
            part = top, norm, acc.reshape(len(top), -1)
            if key != own:
                yield from close()
                own, ids, state = key, own_ids, part
            else:
                state = _merge(state, part)
    yield from close()


def attention_rows(queries: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """``i, vals``: softmax(q kT / sqrt(width)) v for ``queries(i, q)`` against all of ``pairs(i, k, v)``, arrays of doubles without nulls.

    Ids are whole numbers, each once. No pairs give no rows.
    """
    asks = queries.select(F.col("i").cast("long").alias("i"), F.col("q").cast("array<double>").alias("q"))
    holds = pairs.select(F.col("i").cast("long").alias("i"), F.col("k").cast("array<double>").alias("k"), F.col("v").cast("array<double>").alias("v"))
    (asks, n_asks), (holds, n_holds) = _tiled(asks, ("i", "q"), "i"), _tiled(holds, ("k", "v"), "i")
    chunk = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long"))
    q = asks.select(F.col("block").alias("own"), F.explode(chunk(math.ceil(n_holds / MEET))).alias("chunk"), F.lit(False).alias("keyed"), F.lit(-1).cast("long").alias("block"), F.col("q").alias("x"), F.col("i").alias("y"))
    kv = holds.select(F.explode(chunk(n_asks)).alias("own"), F.expr(f"block div {MEET}").alias("chunk"), F.lit(True).alias("keyed"), "block", F.col("k").alias("x"), F.col("v").alias("y"))
    dealt = q.union(kv).repartition("own", "chunk").sortWithinPartitions("own", "chunk", "keyed", "block")
    states = dealt.select("own", "keyed", "x", "y").mapInArrow(_states(1.0 / math.sqrt(width)), _STATE)
    return states.repartition("own").sortWithinPartitions("own").mapInArrow(_merged, "i long, vals array<double>")
