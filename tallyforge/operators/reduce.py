"""Sums, counts, histograms and losses: partial aggregation, then one small shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(df: DataFrame, value: Column, name: str = "total") -> DataFrame:
    """One row; 0 for no rows."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def block_sum(vec: DataFrame, block: int = 1024) -> DataFrame:
    """``block, total`` over runs of ``block`` indices."""
    return vec.groupBy(F.expr(f"idx div {block}").alias("block")).agg(F.sum("v").alias("total"))


def subarray_sum(vec: DataFrame, first: int, last: int) -> DataFrame:
    """Sum over first <= idx <= last; 0 where that is empty."""
    return total(vec.filter(F.col("idx").between(first, last)), F.col("v"))


def subarray_sum_2d(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return total(cells.filter(F.col("i").between(*rows) & F.col("j").between(*cols)), F.col("v"))


def count_equal(df: DataFrame, value: Column, wanted) -> DataFrame:
    return df.agg(F.count_if(value == wanted).alias("n"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """``bin, cnt`` for 0 <= bin < bins, empty bins too; other values are left out."""
    counts = df.select(value.cast("int").alias("bin")).filter(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("cnt"))


def radix_histogram(keys: DataFrame, key: str, shift: int, mask: int = 0, prefix: int = 0) -> DataFrame:
    """Counts of one byte of ``key`` among keys whose ``mask`` bits equal ``prefix``."""
    held = keys.filter(F.col(key).bitwiseAND(mask) == prefix)
    return held.groupBy(F.shiftrightunsigned(key, shift).bitwiseAND(255).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def dot(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return total(df, a * b, "dot")


def dot_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two vectors paired by index."""
    return dot(a.select("idx", F.col("v").alias("a")).join(b.select("idx", F.col("v").alias("b")), "idx"), F.col("a"), F.col("b"))


def mean_squared_error(df: DataFrame, predicted: Column, target: Column) -> DataFrame:
    gap = predicted - target
    return df.agg(F.avg(gap * gap).alias("mse"))


def cross_entropy(df: DataFrame, logits: Column, label: Column) -> DataFrame:
    """Mean of log-sum-exp less the label's logit; labels count from 0."""
    top = F.array_max(logits)
    rest = F.aggregate(logits, F.lit(0.0), lambda s, z: s + F.exp(z - top))
    return df.select((F.ln(rest) + top - F.get(logits, label.cast("int"))).alias("loss")).agg(F.avg("loss").alias("loss"))


def column_moments(cells: DataFrame) -> DataFrame:
    """``j, mean, variance`` (population)."""
    return cells.groupBy("j").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))


def _exp_terms(cells: DataFrame, *more: Column) -> DataFrame:
    """``i, top, total`` and the maxima of ``more`` in one pass over cells.

    Values are summed as exp(v - 512 b) within steps b of 512, which neither
    overflows nor loses them, by partial aggregation; a row's few steps are
    then brought to its maximum.
    """
    step = F.floor(F.col("v") / 512.0)
    names = [f"m{k}" for k in range(len(more))]
    parts = cells.groupBy("i", step.alias("b")).agg(F.max("v").alias("top"), F.sum(F.exp(F.col("v") - step * 512.0)).alias("s"), *[F.max(m).alias(n) for n, m in zip(names, more, strict=True)])
    rows = parts.groupBy("i").agg(F.max("top").alias("top"), F.collect_list(F.struct("b", "s")).alias("parts"), *[F.max(n).alias(n) for n in names])
    total = F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["s"] * F.exp(p["b"] * 512.0 - F.col("top")))
    return rows.select("i", "top", total.alias("total"), *names)


def row_softmax_terms(cells: DataFrame) -> DataFrame:
    """``i, top, total``: each row's maximum and its sum of exp(v - top)."""
    return _exp_terms(cells)


def cross_entropy_cells(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """The same loss where classes are rows: ``cells(i, j, v)`` and ``labels(i, label)``; cells are read once."""
    rows = _exp_terms(cells.join(labels, "i"), F.when(F.col("j") == F.col("label"), F.col("v")))
    return rows.select((F.ln("total") + F.col("top") - F.col("m0")).alias("loss")).agg(F.avg("loss").alias("loss"))


def argmin_rows(cells: DataFrame) -> DataFrame:
    """``i, j``: where each row is least; the lowest ``j`` of equals."""
    return cells.groupBy("i").agg(F.min(F.struct("v", "j")).alias("m")).select("i", F.col("m.j").alias("j"))


def max_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``most, scale``: greatest absolute difference of two vectors, and greatest absolute value of the second."""
    both = a.select("idx", F.col("v").alias("a")).join(b.select("idx", F.col("v").alias("b")), "idx")
    return both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("most"), F.max(F.abs("b")).alias("scale"))
