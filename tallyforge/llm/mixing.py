"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Each source gets a target number of words. A document's expected copies are
``target / source size``; they are prefix-summed within the source, one random
offset is added, and a copy is emitted for each integer boundary crossed.
Documents stand in order of size, largest first, so that the words taken stay
within about one long document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_parts, stored, word_count

WEIGHT_CYCLE = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
CAP = 2.0


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = WEIGHT_CYCLE, share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """``sizes(source, source_size, n_docs)`` with each source's ``target``.

    Sources in code-point order, null last, weigh ``cycle`` in turn. They share
    ``share`` times all sizes by weight, none above ``cap`` times its size; the
    excess is shared again by weight. In closed form: with sources in order of
    cap / weight, the level is what the capped ones leave, over the weights of
    the rest, for the first source that stays under its cap at that level (the highest such level). One
    row for each source, so these windows are small beside the documents.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    pick = F.get(F.array(*map(F.lit, cycle)), F.pmod(F.col("rank") - 1, F.lit(len(cycle))).cast("int"))
    ranked = ranked.withColumn("weight", pick).withColumn("cap", F.lit(cap) * F.col("source_size"))
    everything = W.partitionBy()
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    final = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return ranked.select("source", "source_size", F.least(F.coalesce(final * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def offset_of(source: Column, seed: str) -> Column:
    """A number in [0, 1) for each source, the same in every run with this seed."""
    name = F.when(source.isNull(), F.lit(f"{seed}:null")).otherwise(F.concat(F.lit(f"{seed}:s:"), source))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", cycle: tuple[float, ...] = WEIGHT_CYCLE, share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """One row for each document: how many copies the mix takes of it.

    Columns: ``id_col``, ``source``, ``size`` (words), ``source_size``,
    ``target`` (of its source), ``copies``, ``taken`` (words, repeats counted),
    ``body`` (a hash of the text).

    Null text has size 0; a source of size 0 has target 0 and gives nothing.
    Null is a source of its own. Repeated rows count each and may get different
    numbers of copies. Ties in size go by id, nulls last, then by the text's hash. Texts of any length
    are counted whole. An empty table gives an empty result; other columns are
    not looked at. A boundary is computed by one expression for the document
    before it and the one behind it, so rounding moves a copy between those
    two at most and never loses one.

    The row number within a source is built from counts for each range of
    (source, size, id, text), so no source is ordered in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("body"))
    rows = stored(rows, "mix-sizes")  # the ranges are sampled from this, not from the texts
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("id").asc_nulls_last(), F.col("body")]
    # Rows equal in all of these are alike: a last key lets them spread over ranges.
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_parts(spark), *order, "tie").drop("tie").withColumn("part", F.spark_partition_id())
    rows = stored(rows, "mix-rows")

    parts = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("part_size"))
    sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), before.alias("before"))
    targets = source_targets(sizes, cycle, share, cap).select(F.col("source").alias("t"), "source_size", "target")

    within = W.partitionBy("source", "part").orderBy(*order[1:])
    rows = rows.withColumn("at", F.row_number().over(within))
    # Rows of starts and targets: at most ranges + sources, and sources.
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("t")))
    k = (F.col("before") + F.col("at")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", rate).withColumn("offset", offset_of(F.col("source"), seed))
    crossed = F.floor(k * F.col("rate") + F.col("offset")) - F.floor((k - 1) * F.col("rate") + F.col("offset"))
    rows = rows.withColumn("copies", F.greatest(F.lit(0), crossed).cast("long"))
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "body")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` once for every copy taken, all columns as they were.

    Rows that agree in id, source and text share their copies evenly.
    """
    # The row travels as one struct, so that no name of its columns can clash.
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("body"))
    counts = mix(docs.select(id_col, source_col, text_col), id_col, text_col, source_col, **options)
    counts = counts.groupBy(F.col(id_col).alias("i"), F.col("source").alias("s"), F.col("body").alias("b")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    rows = keyed.join(counts, F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("body") == F.col("b")))
    alone = rows.filter("rows = 1").withColumn("n", F.col("copies"))
    nth = F.row_number().over(W.partitionBy("id", "source", "body").orderBy(F.lit(0)))
    among = rows.filter("rows > 1").withColumn("n", F.floor(F.col("copies") / F.col("rows")) + (nth <= F.col("copies") % F.col("rows")).cast("long"))
    rows = alone.unionByName(among).filter("n > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")
