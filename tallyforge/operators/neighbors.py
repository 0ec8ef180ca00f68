"""Exact nearest neighbours in three dimensions over the leaves of a k-d tree split by load."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ingress import materialised

#: Points that a leaf should have, and how many times that it may have at most.
LEAF, OVER = 512, 4
#: Points drawn to place the cuts of a round, all leaves together.
DRAWN = 1 << 16
#: Leaves that a point asks first, nearest ones before all others within reach.
FIRST = 8
#: Pairs of points and leaves looked at together.
PAIRS = 1 << 20
_ASK = "idx long, x double, y double, z double, leaf int"


class Tree:
    """Cuts of space: node n sends points with ``p[axis[n]] < cut[n]`` to ``low[n]``, others to ``high[n]``; leaves have axis -1."""

    def __init__(self) -> None:
        self.axis, self.cut, self.low, self.high = [-1], [0.0], [0], [0]
        self.box: np.ndarray | None = None  # of each node: its points' least and greatest coordinates

    def split(self, node: int, drawn: np.ndarray, parts: int) -> None:
        """Cut a leaf at medians of the points drawn from it until it has about ``parts`` leaves."""
        todo = [(node, drawn, parts)]
        while todo:
            node, p, parts = todo.pop()
            if parts < 2 or len(p) < 2:
                continue
            for axis in np.argsort(-(p.max(axis=0) / 2 - p.min(axis=0) / 2), kind="stable"):  # halves: the span itself may overflow
                values = np.unique(p[:, axis])
                if len(values) > 1:
                    break
            else:
                continue
            cut = float(np.clip(np.partition(p[:, axis], len(p) // 2)[len(p) // 2], values[1], None))
            self.axis[node], self.cut[node] = int(axis), cut
            for side in (self.low, self.high):
                side[node] = len(self.axis)
                for column, value in ((self.axis, -1), (self.cut, 0.0), (self.low, 0), (self.high, 0)):
                    column.append(value)
            below = p[:, axis] < cut
            todo += [(self.low[node], p[below], parts // 2), (self.high[node], p[~below], parts - parts // 2)]

    def leaves(self, p: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        axis, cut, low, high = (np.array(x) for x in (self.axis, self.cut, self.low, self.high))
        at = np.zeros(len(p), np.int32)
        while True:
            inner = np.flatnonzero(axis[at] >= 0)
            if not len(inner):
                return at
            n = at[inner]
            at[inner] = np.where(p[inner, axis[n]] < cut[n], low[n], high[n])

    def bound(self, boxes: dict[int, tuple[float, ...]]) -> None:
        """Take the boxes of the leaves, and put those of the nodes above around them."""
        self.box = np.empty((len(self.axis), 2, 3))
        self.box[:, 0], self.box[:, 1] = np.inf, -np.inf
        for leaf, b in boxes.items():
            self.box[leaf] = np.reshape(b, (2, 3))
        for n in range(len(self.axis) - 1, -1, -1):  # nodes stand after those above them
            if self.axis[n] >= 0:
                pair = self.box[[self.low[n], self.high[n]]]
                self.box[n] = pair[:, 0].min(axis=0), pair[:, 1].max(axis=0)

    def reached(self, p: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Leaves whose box is as near as ``d`` to any of the points."""
        found, todo = [], [(0, np.arange(len(p)))]
        while todo:
            n, own = todo.pop()
            own = own[away(p[own], self.box[n]) <= d[own]]
            if not len(own):
                continue
            if self.axis[n] < 0:
                found.append(n)
            else:
                todo += [(self.low[n], own), (self.high[n], own)]
        return np.array(sorted(found), np.int32)


def away(p: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The least squared distance of each point to a box, rounded down; NaN for an empty box."""
    if not (box[0] <= box[1]).all():
        return np.full(len(p), np.nan)
    with np.errstate(over="ignore", invalid="ignore"):
        gap = np.maximum(0.0, np.maximum(box[0] - p, p - box[1]))
        return (gap * gap).sum(axis=1) * (1 - 1e-12)


def nearest(asks: np.ndarray, ids: np.ndarray, points: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and number of the nearest of ``points`` (numbers ``others``, ascending) for each of ``asks``, itself left out; -1 where there is none."""
    d, o = np.full(len(asks), np.inf), np.full(len(asks), -1, np.int64)
    step = (1 << 20) // len(points) + 1
    for a in range(0, len(asks), step):
        with np.errstate(over="ignore", invalid="ignore"):
            far = [asks[a : a + step, c, None] - points[None, :, c] for c in range(3)]
            far = far[0] * far[0] + far[1] * far[1] + far[2] * far[2]
        own = ids[a : a + step, None] == others[None]
        far[own | np.isnan(far)] = np.inf
        at, rows = far.argmin(axis=1), np.arange(len(far))
        # A distance may be too large for a double: then the first other one.
        at = np.where(np.isinf(far[rows, at]), own.argmin(axis=1), at)
        there = ~own[rows, at]
        d[a : a + step], o[a : a + step] = np.where(there, far[rows, at], np.inf), np.where(there, others[at], -1)
    return d, o


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("idx").to_numpy(), np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"idx": pa.int64(), "o": pa.int64(), "leaf": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.float64())) for n, v in columns.items()], list(columns))


def _dealt(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.stack([b.column(i).to_numpy() for i in (1, 2, 3)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaves(p), pa.int32())], ["idx", "x", "y", "z", "leaf"])

    return run


def _inside(table: pa.Table) -> pa.Table:
    """The nearest within each leaf."""
    ids, p = _columns(table)
    order = np.argsort(ids)
    d, o = nearest(p, ids, p[order], ids[order])
    return pa.Table.from_batches([_rows(idx=ids, x=p[:, 0], y=p[:, 1], z=p[:, 2], d=d, o=o, leaf=table.column("leaf").to_numpy())])


def _asked(tree: Tree, p: np.ndarray, d: np.ndarray, own: np.ndarray, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of a point, leaf) of what points ask: the nearest few leaves, or all others within reach."""
    todo = [np.argsort(d, kind="stable")[a : a + 1024] for a in range(0, len(p), 1024)]
    while todo:
        s = todo.pop()
        near = tree.reached(p[s], d[s])
        if len(near) * len(s) > PAIRS and len(s) > 1:  # far points among others
            todo += [s[: len(s) // 2], s[len(s) // 2 :]]
        elif len(near):
            dist = np.stack([away(p[s], tree.box[n]) for n in near], axis=1)
            dist[(near[None] == own[s, None]) | ~(dist <= d[s, None])] = np.nan
            # What is within reach has all nearer leaves within reach, so places are the same in both turns.
            place = dist.argsort(axis=1, kind="stable").argsort(axis=1)
            i, j = np.nonzero(~np.isnan(dist) & ((place < FIRST) if first else (place >= FIRST)))
            yield s[i], near[j]


def _asking(tree: Tree, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, p = _columns(b)
            d, own = (b.column(n).to_numpy() for n in ("d", "leaf"))
            for i, leaf in _asked(tree, p, d, own, first):
                yield _rows(idx=ids[i], x=p[i, 0], y=p[i, 1], z=p[i, 2], leaf=leaf)

    return run


def _answers(asks: pa.Table, holds: pa.Table) -> pa.Table:
    """What a leaf's points say to those that ask it."""
    ids, p = _columns(asks)
    others, points = _columns(holds)
    if not len(ids) or not len(others):
        return pa.Table.from_batches([_rows(idx=ids[:0], d=np.zeros(0), o=ids[:0])])
    order = np.argsort(others)
    d, o = nearest(p, ids, points[order], others[order])
    return pa.Table.from_batches([_rows(idx=ids, d=d, o=o)])


def _tree(places: DataFrame, n: int) -> tuple[Tree, DataFrame]:
    """A tree over ``places(idx, x, y, z)`` whose leaves have at most ``OVER * LEAF`` points, and the points with their leaf.

    Each round draws a sample (``DRAWN``, or 32 for each of them if that is
    more) from the leaves that hold too many, by counts over all points, and
    cuts these again.
    """
    tree, crowded, dealt = Tree(), {0: n}, None
    while True:
        wanted = sum(crowded.values())
        source = places
        if dealt is not None:
            source = dealt.join(F.broadcast(places.sparkSession.createDataFrame([(k,) for k in crowded], "leaf int")), "leaf")
        drawn = source.sample(False, min(1.0, max(DRAWN, 32 * len(crowded)) / wanted), 5).select("x", "y", "z").toPandas().to_numpy(np.float64)
        leaf = tree.leaves(drawn)
        for node, count in crowded.items():
            tree.split(node, drawn[leaf == node], min(-(-count // LEAF), max(1, int((leaf == node).sum()) // 8)))
        dealt = materialised(places.mapInArrow(_dealt(tree), "idx long, x double, y double, z double, leaf int"))
        loads = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"lo{c}") for c in "xyz"], *[F.max(c).alias(f"hi{c}") for c in "xyz"]).collect()
        before, crowded = crowded, {r["leaf"]: r["n"] for r in loads if r["n"] > OVER * LEAF}
        if not crowded or crowded == before:
            tree.bound({r["leaf"]: tuple(r)[2:] for r in loads})
            return tree, dealt


def nearest_neighbour(points: DataFrame) -> DataFrame:
    """``idx, nn``: the index of the nearest other point, the lowest of equals; -1 where there is none.

    Points that share a place are settled by one aggregate. Distinct places
    are dealt to the leaves of a k-d tree, which is cut at medians where counts
    over all points say that a leaf holds too many, so clumps of any density
    and far points make no crowded leaf. A point is compared with its own leaf,
    then asks the leaves whose box is nearer than what it has found: the
    nearest eight at first, which leaves few others within reach. Driver and
    tasks hold the tree, one node for some hundred points. Points with a null
    or NaN coordinate get -1 and are nobody's neighbour.
    """
    good = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz")
    valid = points.filter(good)
    places = materialised(valid.groupBy("x", "y", "z").agg(F.min("idx").alias("idx"), F.max("idx").alias("last")))
    n = places.count()
    twins = valid.join(places.filter("idx <> last").select("x", "y", "z", F.col("idx").alias("first")), ["x", "y", "z"])
    second = twins.filter("idx <> first").groupBy("x", "y", "z").agg(F.min("idx").alias("second"))
    twins = twins.join(second, ["x", "y", "z"]).select("idx", F.when(F.col("idx") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("twin"))
    out = points.select("idx").join(twins, "idx", "left")
    if n < 2:
        return out.select("idx", F.coalesce("twin", F.lit(-1)).cast("long").alias("nn"))
    tree, dealt = _tree(places.select(F.col("idx").cast("long"), *[F.col(c).cast("double") for c in "xyz"]), n)
    best = materialised(dealt.groupBy("leaf").applyInArrow(_inside, "idx long, x double, y double, z double, d double, o long, leaf int"))
    for first in (True, False):
        asks = best.mapInArrow(_asking(tree, first), _ASK)
        said = asks.groupBy("leaf").cogroup(dealt.groupBy("leaf")).applyInArrow(_answers, "idx long, d double, o long")
        said = said.filter("o >= 0").groupBy("idx").agg(F.min(F.struct("d", "o")).alias("m"))
        old = F.struct(F.when(F.col("o") >= 0, F.col("d")).otherwise(F.lit(None)).alias("d"), F.when(F.col("o") >= 0, F.col("o")).alias("o"))
        win = F.when(F.col("o") < 0, F.col("m")).when(F.col("m").isNull() | (old <= F.col("m")), old).otherwise(F.col("m"))
        best = best.join(said, "idx", "left").withColumn("win", win)
        best = materialised(best.select("idx", "x", "y", "z", F.coalesce("win.d", "d").alias("d"), F.coalesce("win.o", "o").alias("o"), "leaf"))
    return out.join(best.select("idx", F.col("o").alias("found")), "idx", "left").select("idx", F.coalesce("twin", "found", F.lit(-1)).cast("long").alias("nn"))
