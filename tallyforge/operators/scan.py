"""Prefix sums in two levels: a window in each block of indices, and offsets from the blocks' totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 16


def block_prefix_sum(vec: DataFrame, block: int = 1024, inclusive: bool = False) -> DataFrame:
    """``idx, total`` within each run of ``block`` indices."""
    own = vec.withColumn("block", F.expr(f"idx div {block}"))
    frame = W.partitionBy("block").orderBy("idx").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    return own.select("idx", F.coalesce(F.sum("v").over(frame), F.lit(0)).cast(vec.schema["v"].dataType if vec.schema["v"].dataType.typeName() == "double" else "long").alias("total"))


def prefix_sum(vec: DataFrame, inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """``idx, total`` over the whole vector; no task sees more than a block and the blocks' totals.

    The totals are scanned in two levels as well, so their one-task scan has a
    row for each ``block`` squared of indices.
    """
    kind = "double" if vec.schema["v"].dataType.typeName() == "double" else "long"
    vec = vec.withColumn("b", F.expr(f"idx div {block}"))
    totals = vec.groupBy("b").agg(F.sum("v").alias("t")).withColumn("g", F.expr(f"b div {block}"))
    groups = totals.groupBy("g").agg(F.sum("t").alias("gt"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("g", before("gt", W.orderBy("g")).alias("g0"))
    starts = totals.withColumn("b0", before("t", W.partitionBy("g").orderBy("b"))).join(groups, "g").select("b", (F.col("b0") + F.col("g0")).alias("start"))
    frame = W.partitionBy("b").orderBy("idx").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = vec.select("idx", "b", F.coalesce(F.sum("v").over(frame), F.lit(0)).alias("local"))
    return local.join(starts, "b").select("idx", (F.col("local") + F.col("start")).cast(kind).alias("total"))


def suffix_counts(bins: DataFrame) -> DataFrame:
    """Add ``at_least`` to ``bin, cnt``: how many values lie in this bin or a higher one."""
    return bins.withColumn("at_least", F.sum("cnt").over(W.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)))


def rank_in_histogram(bins: DataFrame, need: int) -> DataFrame:
    """``bin, above``: the highest bin that with those over it holds ``need`` values, and how many lie above it."""
    found = suffix_counts(bins).filter(F.col("at_least") >= need)
    return found.agg(F.max(F.struct("bin", (F.col("at_least") - F.col("cnt")).alias("above"))).alias("m")).select("m.bin", "m.above")
