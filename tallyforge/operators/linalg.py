"""Matrices as cells ``i, j, v``: dense products by tiles, sparse ones by joins on the shared index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ingress import materialised, rows
from . import tiles as T
from .attention import attention_rows


def transpose(cells: DataFrame) -> DataFrame:
    """A renaming: nothing moves."""
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    """``scale * a * b`` for every row of ``a`` and column of ``b`` whose tiles meet; absent cells are zeros."""
    product = T.cells_of(T.scaled(T.multiply(T.tiles(a), T.tiles(b)), scale))
    return product.select(F.col("i").cast(a.schema["i"].dataType).alias("i"), F.col("j").cast(b.schema["j"].dataType).alias("j"), "v")


def gemm(a: DataFrame, b: DataFrame, c: DataFrame, alpha: float, beta: float) -> DataFrame:
    """``alpha * a * b + beta * c``; ``c`` is not read where beta is 0. Tiles of ``c`` are summed with those of the product."""
    if beta == 0:
        return matmul(a, b, alpha)
    both = T.scaled(T.multiply(T.tiles(a), T.tiles(b)), alpha).union(T.scaled(T.tiles(c), beta))
    return T.cells_of(T.summed(both)).select(F.col("i").cast(a.schema["i"].dataType).alias("i"), F.col("j").cast(b.schema["j"].dataType).alias("j"), "v")


def spmv(cells: DataFrame, x: DataFrame, wanted: DataFrame) -> DataFrame:
    """``i, y`` for each of ``wanted(i)``: zeros of ``cells`` take no part, rows without cells give 0. ``x(j, x)``.

    Cells of a hub column (more than a quarter of a task's share) stay where
    they lie and get their number of ``x`` by broadcast: four columns for each
    task at most, whatever the matrix. The other cells are dealt by column. Of
    a hub row each task sends one partial sum.
    """
    held = materialised(cells.filter("v <> 0").select("i", "j", "v"))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    loads = materialised(held.groupBy("j").agg(F.count(F.lit(1)).alias("w")))
    bar = max(1, (loads.agg(F.sum("w")).first()[0] or 0) // (4 * parts))
    hubs = loads.filter(F.col("w") > bar).select("j")
    near = held.join(F.broadcast(x.join(F.broadcast(hubs), "j")), "j")
    far = held.join(F.broadcast(hubs), "j", "left_anti").join(x, "j")
    y = near.unionByName(far).groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return wanted.select("i").join(y, "i", "left").select("i", F.coalesce("y", F.lit(0.0)).alias("y"))


def matrix_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("i", "j", F.col("v").alias("w")), ["i", "j"]).select("i", "j", (F.col("v") + F.col("w")).alias("v"))


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a0 b0 a1 b1 ...``."""
    return a.select((F.col("idx") * 2).alias("idx"), "v").union(b.select((F.col("idx") * 2 + 1).alias("idx"), "v"))


def attention(q: DataFrame, k: DataFrame, v: DataFrame, width: int) -> DataFrame:
    """softmax(q kT / sqrt(width)) v, for every row of ``q`` against all rows of ``k`` and ``v``, as cells; rows are dense."""
    pairs = rows(k).select("i", F.col("vals").alias("k")).join(rows(v).select("i", F.col("vals").alias("v")), "i")
    out = attention_rows(rows(q).select("i", F.col("vals").alias("q")), pairs, width)
    return out.select("i", F.posexplode("vals").alias("j", "v"))
