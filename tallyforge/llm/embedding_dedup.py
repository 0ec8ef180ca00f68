"""Embedding near-duplicates: PCA-ordered tiles, compared by leading dimensions first.

1. Equal vectors are one class with a count, so copies are never compared.
2. The second moments of all unit vectors are summed where they lie; their
   principal axes, largest first, carry most of every product in few numbers.
3. Classes are range-sorted along the first axis and cut into tiles of
   ``TILE``. Vectors of cosine t are at most ``sqrt(2 - 2t)`` apart, on any
   axis too, so only tiles whose boxes over the leading axes come that near
   meet. Tile pairs are dealt to tasks as one tile and up to ``MEET`` partners,
   which stream by.
4. In a pair of tiles the products over the leading axes come first. What the
   rest can add is at most the product of the two suffix norms; pairs that
   cannot reach the threshold stop, the others go on over more axes, and what
   is left is decided by the cosine of the vectors themselves.
5. Links are counted for each class, and only a spanning set of them (one for
   each class and pair of tiles) leaves the task, for connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, discard, join_counted, lean, shuffle_parts, stored
from .components import components
from .texthash import tidy

#: Vectors of a tile, and tiles that meet one in a task.
TILE, MEET = 2048, 8
#: Axes over which products are summed before the first, second... look at what is left.
STOPS = (16, 32)
#: Leading axes of a tile's box.
BOX = 8
#: Rounding of a bound: pairs within it are decided by their cosine.
SLACK = 1e-9
#: The same for the first bound, in single precision: 17 products of numbers up to 1 are off by less.
SINGLE = 1e-5
#: Pairs of vectors of which whole cosines are computed at once.
AT_ONCE = 1 << 15


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small numbers are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(width: int):
    """The sums of products of unit vectors, one row for each cell and task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            u = _unit(_matrix(b.column(0), width))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    return run


def _led(axes: np.ndarray):
    """Each class with its vector as bytes and its place on the first axis."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(_matrix(b.column(2), len(axes)))
            vecs = pa.Array.from_buffers(pa.binary(x.itemsize * len(axes)), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], vecs, pa.array(_unit(x) @ axes[:, 0])], ["class", "m", "vec", "lead"])

    return run


def _tiles(axes: np.ndarray, kind: str):
    """The classes of a tile as one row: its box, and their numbers, counts and vectors as bytes."""
    width, box = len(axes), min(BOX, len(axes))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vecs = b"".join(table.column("vec").to_pylist())
        x = _unit(np.frombuffer(vecs, kind).reshape(-1, width)) @ axes[:, :box]
        lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (x.min(axis=0), x.max(axis=0))]
        parts = [*[table.column(n).to_numpy().astype(np.int64).tobytes() for n in ("class", "m")], vecs]
        return pa.Table.from_arrays([pa.array([table.column("tile")[0].as_py()], pa.int64()), *lists, *[pa.array([p], pa.binary()) for p in parts]], ["tile", "lo", "hi", "classes", "counts", "vecs"])

    return run


class _Tile:
    def __init__(self, classes: bytes, counts: bytes, vecs: bytes, axes: np.ndarray, kind: str) -> None:
        self.classes, self.counts = np.frombuffer(classes, np.int64), np.frombuffer(counts, np.int64)
        self.raw = np.frombuffer(vecs, kind).reshape(-1, len(axes)).astype(np.float64)
        self.raw = self.raw / np.abs(self.raw).max(axis=1, keepdims=True)
        self.norms = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.turned = (self.raw / self.norms[:, None]) @ axes
        behind = np.maximum(0.0, np.cumsum((self.turned * self.turned)[:, ::-1], axis=1)[:, ::-1])
        self.behind = np.sqrt(np.concatenate([behind, np.zeros((len(behind), 1))], axis=1))  # the norm from an axis on


def linked(a: _Tile, b: _Tile, threshold: float, stops: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of ``a`` and ``b`` with a cosine of ``threshold`` or more."""
    width = a.turned.shape[1]
    stops = [s for s in stops if s < width] or [width]
    first = stops[0]
    # The suffix norms stand as one more axis, so the product is the bound; single precision is enough for it.
    x, y = (np.concatenate([t.turned[:, :first], t.behind[:, first : first + 1]], axis=1).astype(np.float32) for t in (a, b))
    i, j = np.nonzero(x @ y.T >= np.float32(threshold - SINGLE))
    out_i, out_j = [], []
    for k in range(0, len(i), AT_ONCE):
        p, q = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
        so_far, done = np.einsum("ij,ij->i", a.turned[p, :first], b.turned[q, :first]), first
        for stop in stops[1:]:
            so_far = so_far + np.einsum("ij,ij->i", a.turned[p, done:stop], b.turned[q, done:stop])
            live = so_far + a.behind[p, stop] * b.behind[q, stop] >= threshold - SLACK
            p, q, so_far, done = p[live], q[live], so_far[live], stop
        cosine = np.einsum("ij,ij->i", a.raw[p], b.raw[q]) / (a.norms[p] * b.norms[q])
        out_i.append(p[cosine >= threshold])
        out_j.append(q[cosine >= threshold])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _spanned(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least node that the edges (i, j) join it with."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, least[i], low)
        np.minimum.at(new, least[j], low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _compared(axes: np.ndarray, kind: str, threshold: float, stops: tuple[int, ...]):
    """Rows (own, chunk, tile, partner, classes, counts, vecs), each own tile before its partners, to (class, n, link)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            for r in range(len(b)):
                tile = _Tile(*(b.column(k)[r].as_py() for k in (3, 4, 5)), axes, kind)
                if not b.column(2)[r].as_py():
                    own, number = tile, b.column(0)[r].as_py()
                    continue
                same = b.column(1)[r].as_py() == number
                i, j = linked(own, tile, threshold, stops)
                if same:
                    i, j = i[i < j], j[i < j]
                n, size = len(own.classes), len(own.classes)
                j = j if same else j + size
                n += 0 if same else len(tile.classes)
                classes = own.classes if same else np.concatenate([own.classes, tile.classes])
                counts = own.counts if same else np.concatenate([own.counts, tile.counts])
                links = np.bincount(i, counts[j], n) + np.bincount(j, counts[i], n)
                rows = np.flatnonzero(links)
                if len(rows):
                    root = _spanned(i, j, n)
                    yield pa.RecordBatch.from_arrays([pa.array(classes[rows]), pa.array(links[rows].astype(np.int64)), pa.array(classes[root[rows]])], ["class", "n", "link"])

    return run


def _tiled(classes: DataFrame, axes: np.ndarray, kind: str) -> DataFrame:
    """``classes(class, m, vec)`` as tiles along the first axis."""
    led = classes.mapInArrow(_led(axes), "class long, m long, vec binary, lead double")
    placed = led.repartitionByRange(shuffle_parts(classes.sparkSession), "lead", "class").sortWithinPartitions("lead", "class")
    placed = checkpointed(placed.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each range.
    starts = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    ranked = placed.select("class", "m", "vec", part.alias("part"), place.alias("place")).join(F.broadcast(starts), "part")
    ranked = ranked.select("class", "m", "vec", F.expr(f"(start + place) div {TILE}").alias("tile"))
    return stored(ranked.groupBy("tile").applyInArrow(_tiles(axes, kind), "tile long, lo array<double>, hi array<double>, classes binary, counts binary, vecs binary"), "emb-tiles", "lz4")


def _meetings(tiles: DataFrame, threshold: float) -> DataFrame:
    """(own, tile): pairs of tiles, own <= tile, whose boxes come near enough for a link."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    boxes = tiles.select("tile", "lo", "hi")
    # Tiles ascend on the first axis: the last one that begins within reach, by counting beginnings in order.
    marks = boxes.select((F.col("hi")[0] + reach).alias("x"), F.lit(1).alias("kind"), "tile").union(boxes.select(F.col("lo")[0].alias("x"), F.lit(0).alias("kind"), "tile"))
    begun = F.sum(1 - F.col("kind")).over(W.orderBy("x", "kind").rowsBetween(W.unboundedPreceding, 0))
    last = marks.withColumn("last", begun - 1).filter("kind = 1").select("tile", "last")
    own = boxes.join(last, "tile").select(F.col("tile").alias("own"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.explode(F.sequence("tile", F.greatest("tile", "last"))).alias("tile"))
    gap = F.zip_with(F.zip_with("lo", "a_hi", lambda x, y: x - y), F.zip_with("a_lo", "hi", lambda x, y: x - y), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    away = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return own.join(boxes, "tile").filter(away <= reach * reach).select("own", "tile")


def _links(classes: DataFrame, width: int, kind: str, threshold: float, stops: tuple[int, ...]) -> DataFrame:
    """``class, n, link``: partial counts of linked vectors of other classes, and links that join all that are linked."""
    cells = classes.select("vec").mapInArrow(_moments(width), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    moments = np.zeros(width * width)
    for r in cells:  # width squared numbers
        moments[r["cell"]] = r["v"]
    axes = np.ascontiguousarray(np.linalg.eigh(moments.reshape(width, width))[1][:, ::-1])
    tiles = _tiled(classes, axes, kind)
    pairs = _meetings(tiles, threshold)
    pairs = stored(pairs.withColumn("chunk", F.expr(f"(tile - own) div {MEET}")), "emb-pairs")
    rows = pairs.withColumn("partner", F.lit(True)).union(pairs.select("own", F.col("own").alias("tile"), "chunk").distinct().withColumn("partner", F.lit(False)))
    dealt = rows.join(tiles.select("tile", "classes", "counts", "vecs"), "tile")
    # A number of tasks of its own: the work is in the products, not in the bytes that adaptive execution sees.
    dealt = dealt.repartition(2 * shuffle_parts(classes.sparkSession), "own", "chunk").sortWithinPartitions("own", "chunk", "partner", "tile")
    return dealt.select("own", "tile", "partner", "classes", "counts", "vecs").mapInArrow(_compared(axes, kind, threshold, stops), "class long, n long, link long")


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, stops: tuple[int, ...] = STOPS) -> DataFrame:
    """One row for each row: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Two rows are linked when the cosine of their vectors, in double precision,
    is at least ``threshold``; ``n_links`` counts the rows linked with one
    directly, ``component_id`` is the smallest id that links reach, itself
    included, and ``kept`` says whether that is its own.

    Vectors that are null, empty, zero or hold null, NaN or an infinite number
    are linked with nothing, vectors of different lengths not with each other.
    Equal vectors are linked. Rows repeated with one id are rows of their own.
    Null ids are never a component's id unless it has no other; such a
    component is null and its rows are kept. An empty table gives an empty
    result; other columns are not looked at. The threshold must be above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and not above 1")
    spark = vectors.sparkSession
    lean(spark)
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    kind, sql = ("<f4", "float") if single else ("<f8", "double")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{sql}>").alias("vec"))
    sound = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)
    good = F.col("vec").isNotNull() & F.forall("vec", sound) & F.exists("vec", lambda v: v != 0)
    base = base.withColumn("vec", F.when(F.coalesce(good, F.lit(False)), F.col("vec")))
    # Partial aggregation leaves one row for each class and task, however many copies there are.
    classes = base.filter("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "emb-classes")
    found = None
    for width in sorted(r[0] for r in classes.select(F.size("vec")).distinct().collect()):
        part = _links(classes.filter(F.size("vec") == width).select("class", "m", "vec"), width, kind, threshold, stops)
        found = part if found is None else found.union(part)
    plain = base.filter("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if found is None:
        return _named(plain, id_col)
    found = stored(found, "emb-links")
    roots = stored(components(found.select(F.col("class").alias("a"), F.col("link").alias("b"))), "emb-roots")
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    rows = classes.join(counts, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    rows = rows.select("vec", "least", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    rows = stored(rows, "emb-rows")
    least = rows.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("w"))
    rows = stored(join_counted(rows, stored(least, "emb-least"), ["root"], "w").select("vec", "m", "n_links", "component_id"), "emb-named")
    discard(found, roots)
    # A vector with many copies is one hot key here.
    out = join_counted(base.filter("vec IS NOT NULL"), rows, ["vec"], "m")
    return _named(out.select("id", "n_links", "component_id").unionByName(plain), id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
