"""Merkle manifest of a table: a digest for every row, one root for all, and a proof for each row.

1. Rows become leaves; leaves of a group ascend by id. They are range-sorted,
   and the sizes of each group in each range give every range the place where
   its first group goes on (one number for each range).
2. Each range cuts its part of a group into complete aligned subtrees of at
   most ``2^STEP`` leaves and builds them where the leaves lie. A range has
   ragged ones (smaller) only at its ends.
3. Only the tops of subtrees move on: they are dealt by their coordinate
   (group, level, node), and a task completes ``STEP`` levels more for at most
   ``2^STEP`` of them, until each group has its subroot.
4. The subroots are leaves of one more such tree, whose top is the root.
5. A subtree meets the path above it once, and the proofs of its leaves are
   written from both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, lean, shuffle_parts, stored

#: Levels that one task builds: a subtree row has at most 1,024 leaves.
STEP = 10
_MANY = 1 << 62


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(columns: list[Column]) -> Column:
    """sha256 over the columns in order: '-' for null, else the byte count, ':' and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


def _grown(hashes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level over an aligned run of leaves; an odd last one rises alone."""
    rows = [hashes]
    for _ in range(levels):
        below = rows[-1]
        rows.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return rows


def _step(node: int, level_nodes: Callable[[int], str | None]) -> str:
    """What a proof says of one level: '<' and a sibling on the left, '>' and one on the right, or nothing."""
    sibling = level_nodes(node ^ 1)
    return "" if sibling is None else ("<" if node & 1 else ">") + sibling


def _cut(start: int, end: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(level, node, first, last + 1) of the largest complete aligned subtrees of leaves start to end - 1 of ``n``."""
    while start < end:
        level = next(k for k in range(min(STEP, height(n)), -1, -1) if start % (1 << k) == 0 and min(start + (1 << k), n) <= end)
        stop = min(start + (1 << level), n)
        yield level, start >> level, start, stop
        start = stop


def _subtrees(edges: dict[int, tuple[int, str, int]]):
    """Sorted leaves of a range (``part, g, leaf, row``) to its subtrees; ``edges``: first place, last group and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group, at, part = None, 0, None

        def close(n: int) -> Iterator[pa.RecordBatch]:
            count = sum(map(len, held))
            leaves, rows = (pa.concat_arrays([b.column(i) for b in held]) for i in (2, 3))
            for level, node, a, z in _cut(at - count, at, n):
                a, z = a - (at - count), z - (at - count)
                top = _grown(leaves.slice(a, z - a).to_pylist(), level)[-1][0]
                lists = [pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), pa.concat_arrays([x.slice(a, z - a)])) for x in (leaves, rows)]
                yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([level], pa.int32()), pa.array([node], pa.int64()), pa.array([top]), *lists], ["g", "level", "node", "hash", "leaves", "rows"])

        for b in batches:
            if not len(b):
                continue
            names = b.column(1)
            turns = np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, len(b) - 1)).to_numpy(zero_copy_only=False)) + 1
            for s, e in zip([0, *turns.tolist()], [*turns.tolist(), len(b)], strict=True):
                name = names[s].as_py()
                if name != group:
                    if held:
                        yield from close(at)
                        held.clear()
                    at = edges[b.column(0)[0].as_py()][0] if group is None else 0
                    group, part = name, b.column(0)[0].as_py()
                while s < e:
                    take = min(e - s, (1 << STEP) - at % (1 << STEP))
                    held.append(b.slice(s, take))
                    at, s = at + take, s + take
                    if at % (1 << STEP) == 0:
                        yield from close(_MANY)
                        held.clear()
        if held:
            _, last, size = edges[part]
            yield from close(size if group == last else at)

    return run


def _risen(bound: int):
    """A group of nodes under one node of level ``bound`` (or the top): their ways up to it."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["g", "level", "node", "hash", "n"]).to_pylist()
        n = rows[0]["n"]
        top = min(bound, height(n))
        nodes = {(r["level"], r["node"]): r["hash"] for r in rows}
        by_level: dict[int, list[int]] = {}
        for level, node in nodes:
            by_level.setdefault(level, []).append(node)
        for level in range(top):
            for node in by_level.get(level, ()):
                if node % 2 == 0 and (level + 1, node // 2) not in nodes:
                    right = [nodes[level, node + 1]] if (node + 1) << level < n else []
                    nodes[level + 1, node // 2] = digest(nodes[level, node], *right)
                    by_level.setdefault(level + 1, []).append(node // 2)

        def way(level: int, node: int) -> list[str]:
            return [_step(node >> (k - level), lambda i, k=k: nodes.get((k, i))) for k in range(level, top)]

        out = [(r["g"], r["level"], r["node"], way(r["level"], r["node"]), top, r["node"] >> (top - r["level"])) for r in rows]
        cols = list(zip(*out, strict=True))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        arrays += [pa.array([nodes[top, x[5]] for x in out]), pa.array([n] * len(out), pa.int64())]
        return pa.Table.from_arrays(arrays, ["g", "level", "node", "way", "up_level", "up_node", "up_hash", "n"])

    return run


_RISEN = "g string, level int, node long, way array<string>, up_level int, up_node long, up_hash string, n long"


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees with the way above them to their leaves with whole proofs."""
    for b in batches:
        for i in range(len(b)):
            level, above = b.column(0)[i].as_py(), b.column(3)[i].as_py()
            leaves, rows = (b.column(k).slice(i, 1).flatten() for k in (1, 2))
            grown = _grown(leaves.to_pylist(), level)
            gets = [lambda j, row=row: row[j] if j < len(row) else None for row in grown]
            proofs = [[_step(j >> k, gets[k]) for k in range(level)] + above for j in range(len(leaves))]
            same = [pa.repeat(b.column(k)[i], len(leaves)) for k in (4, 5)]
            yield pa.RecordBatch.from_arrays([rows, leaves, *same, pa.array(proofs, pa.list_(pa.string()))], ["row", "leaf", "subroot", "root", "proof"])


def _forest(leaves: DataFrame, order: list[Column], label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over ``leaves(g, leaf, row)`` in ``order`` within each ``g``.

    Gives the subtrees ``(g, level, node, hash, leaves, rows)``, the ways
    ``(g, level, node, way)`` above those that are not roots, and ``(g, hash)``
    of the roots.
    """
    spark = leaves.sparkSession
    # Rows equal in all of this are alike, so any order of them is right; the last key lets them spread over ranges.
    placed = leaves.withColumn("tie", F.monotonically_increasing_id())
    by = [F.col("g"), *order, F.col("leaf"), F.col("tie")]
    placed = placed.repartitionByRange(shuffle_parts(spark), *by).sortWithinPartitions(*by)
    placed = checkpointed(placed.select(F.spark_partition_id().alias("part"), "g", "leaf", "row"))
    held = stored(placed.groupBy("part", "g").agg(F.count(F.lit(1)).alias("c")), f"{label}-held")
    every = W.partitionBy("g")
    before = F.coalesce(F.sum("c").over(every.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = held.select("part", "g", before.alias("first"), F.sum("c").over(every).alias("n"))
    # One row for each range.
    edges = spans.groupBy("part").agg(F.min_by("first", "g").alias("first"), F.max_by(F.struct("g", "n"), "g").alias("last")).collect()
    edges = {r["part"]: (r["first"], r["last"]["g"], r["last"]["n"]) for r in edges}
    sizes = held.groupBy("g").agg(F.sum("c").alias("n"))

    row = leaves.schema["row"].dataType
    kind = T.StructType([T.StructField("g", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("leaves", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(row))])
    subtrees = stored(placed.mapInArrow(_subtrees(edges), kind), f"{label}-subtrees")

    most = sizes.agg(F.max("n")).first()[0] or 1
    tops, risen = subtrees.select("g", "level", "node", "hash").join(sizes, "g"), []
    for bound in range(STEP, height(most) + STEP, STEP):
        rises = (F.col("level") < bound) & (F.expr("shiftleft(1L, level)") < F.col("n"))
        block = F.expr(f"shiftright(node, {bound} - level)")
        risen.append(stored(tops.filter(rises).groupBy("g", block.alias("block")).applyInArrow(_risen(bound), _RISEN), f"{label}-ways"))
        up = risen[-1].select("g", F.col("up_level").alias("level"), F.col("up_node").alias("node"), F.col("up_hash").alias("hash"), "n")
        tops = tops.filter(~rises).unionByName(up.distinct())
    ways = spark.createDataFrame([], "g string, level int, node long, way array<string>")
    for r in reversed(risen):
        above = ways.select("g", F.col("level").alias("up_level"), F.col("node").alias("up_node"), F.col("way").alias("above"))
        whole = r.join(above, ["g", "up_level", "up_node"], "left").select("g", "level", "node", F.concat("way", F.coalesce("above", _none())).alias("way"))
        ways = ways.union(whole)
    return subtrees, ways, stored(tops.select("g", "hash"), f"{label}-roots")


def _none() -> Column:
    return F.array().cast("array<string>")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row: ``id_col``, ``leaf``, ``subroot``, ``root``, ``proof``, and the columns of ``carry``.

    A leaf is ``leaf_of(columns)``. Per ``group_col`` leaves ascend by
    ``id_col``, rows of one id by leaf; every two nodes in a row, or an odd
    last one alone, become the digest of their digests. Subroots in order of
    the group's bytes, null first, likewise give the root. ``proof`` has one
    step for each level from the leaf to the root: '<' and a sibling's digest
    that stands left, '>' and one that stands right, '' for a node alone;
    ``folded`` checks it.

    Null ids come first in their group, null groups are a group, null values
    are '-'; texts of any length are digested whole. Equal rows have a leaf
    each. An empty table gives an empty result. Columns not named are not
    looked at.
    """
    lean(docs.sparkSession)
    carry = carry or {}
    group = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    row = F.struct(F.col(id_col).alias("id"), F.struct(F.lit(0).alias("none"), *[c.alias(name) for name, c in carry.items()]).alias("more"))
    leaves = docs.select(group.alias("g"), leaf_of([F.col(c) for c in columns]).alias("leaf"), row.alias("row"))
    leaves = stored(leaves, "merkle-leaves")  # texts are read once, not again for the ranges
    subtrees, ways, subroots = _forest(leaves, [F.col("row.id").asc_nulls_first()], "merkle")
    top = subroots.select(F.lit("").alias("g"), F.col("hash").alias("leaf"), F.struct(F.col("g").alias("id")).alias("row"))
    upper, upper_ways, root = _forest(top, [F.col("row.id")], "merkle-top")
    tops = _proofs(upper, upper_ways, root.select("g", F.col("hash").alias("subroot")), root.select("g", F.col("hash").alias("root"), _none().alias("above")))
    tops = stored(tops.select(F.col("row.id").alias("g"), "root", F.col("proof").alias("above")), "merkle-tops")
    out = _proofs(subtrees, ways, subroots.select("g", F.col("hash").alias("subroot")), tops)
    return out.select(F.col("row.id").alias(id_col), "leaf", "subroot", "root", "proof", *[F.col(f"row.more.`{name}`").alias(name) for name in carry])


def _proofs(subtrees: DataFrame, ways: DataFrame, subroots: DataFrame, tops: DataFrame) -> DataFrame:
    """``row, leaf, subroot, root, proof`` of all leaves; ``tops(g, root, above)`` stand above the subroots."""
    above = tops.join(subroots, "g")
    met = subtrees.join(ways, ["g", "level", "node"], "left").join(above, "g")
    met = met.select("level", "leaves", "rows", F.concat(F.coalesce("way", _none()), "above").alias("above"), "subroot", "root")
    row = subtrees.schema["rows"].dataType.elementType
    kind = T.StructType([T.StructField("row", row), *[T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root")], T.StructField("proof", T.ArrayType(T.StringType()))])
    return met.mapInArrow(_expanded, kind)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and a proof give."""
    step = lambda h, s: F.sha2(F.when(s.startswith("<"), F.concat(F.substring(s, 2, 64), h)).otherwise(F.concat(h, F.substring(s, 2, 64))), 256)
    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """sha256 over the siblings of a proof, in order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)
