"""Exact deduplication by content sort (DataFrame operations only).

Sampled splitters deal rows into ranges of their normalised content, each
range is sorted (Spark's external sort), and neighbours are compared in full.
Splitters carry the document id behind the content, so the copies of one hot
text spread over many ranges; the few runs that touch a splitter are then
joined up across ranges by comparing their texts in full again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_parts, squashed, stored

#: Sampled keys for each range; a key has at most about 150 bytes.
SAMPLES_PER_RANGE = 48
SEP = "\u0001"


def _literal_array(values: list[str]) -> Column:
    """One folded literal, whatever the number of values."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=True)), "array<string>")


def _last_at_most(key: Column, splitters: list[str]) -> Column:
    """How many of the sorted ``splitters`` are <= ``key``: a binary search."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]
    arr = _literal_array(splitters)
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, s: F.when(F.get(arr, at + s - 1) <= key, at + s).otherwise(at),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row for each input row: its group of equal texts and whether it stays.

    Texts are equal when identical after each run of ASCII white space is
    replaced by one space. Columns: ``id_col``, ``keep_id`` (smallest id of
    the group), ``group_size``, ``kept``, ``text_sha256`` (of the normalised
    text). Other columns are not looked at, whatever their names.

    Null text counts as empty. Null ids sort after all others and are never a
    ``keep_id`` unless the whole group has none. Rows repeated with one id
    count each in ``group_size``; exactly one row of a group is kept. Texts of
    any length are compared whole. An empty table gives an empty result. ``ranges`` is 4 for each shuffle partition
    unless given.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * shuffle_parts(spark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def keyed(part: DataFrame) -> DataFrame:
        part = squashed(part, "text", "norm").select("id", "norm")
        return part.withColumn("content", F.concat(F.substring("norm", 1, 24), F.lit(SEP), F.lpad(F.hex(F.xxhash64("norm")), 16, "0")))

    order_key = F.concat("content", F.lit(SEP), F.lpad(F.hex(F.xxhash64("id")), 16, "0"))

    total = docs.count()
    share = min(1.0, SAMPLES_PER_RANGE * ranges / max(total, 1))
    # Rows are drawn before their texts are normalised.
    sample = sorted(r[0] for r in keyed(base.sample(False, share, 11)).select(order_key).collect())
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    at = _last_at_most(F.col("key"), cuts)
    ends = _literal_array(cuts)
    rows = keyed(base).withColumn("key", order_key).withColumn("bucket", at).drop("key")
    touches = lambda i: F.coalesce(F.startswith(F.get(ends, i), F.col("content")), F.lit(False))

    by_content = W.partitionBy("bucket").orderBy("content", "norm", F.col("id").asc_nulls_last())
    before = F.lag("norm").over(by_content)
    rows = rows.withColumn("opens", before.isNull() | (before != F.col("norm")))
    rows = rows.withColumn("run", F.sum(F.col("opens").cast("long")).over(by_content.rowsBetween(W.unboundedPreceding, 0)))
    edge = touches(F.col("bucket") - 1) | touches(F.col("bucket"))
    rows = rows.select("id", "bucket", "run", F.sha2(F.col("norm"), 256).alias("sha"), F.when(F.col("opens") & edge, F.col("norm")).alias("edge_text"))
    in_run = W.partitionBy("bucket", "run")
    rows = rows.select(
        "*",
        F.min("id").over(in_run).alias("run_keep"),
        F.count(F.lit(1)).over(in_run).alias("run_size"),
        (F.row_number().over(in_run.orderBy(F.col("id").asc_nulls_last())) == 1).alias("leads"),
    )
    rows = stored(rows, "exact-runs")

    # At most two runs (and rare hash collisions) touch a splitter, so this has about 2 * ranges rows.
    parts = rows.filter(F.col("edge_text").isNotNull()).select("edge_text", "bucket", "run", "run_keep", "run_size")
    whole = parts.groupBy("edge_text").agg(F.min("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"))
    joined = parts.join(whole, "edge_text").select("bucket", "run", "all_keep", "all_size")
    out = rows.join(F.broadcast(joined), ["bucket", "run"], "left")
    out = out.withColumn("keep", F.when(F.col("all_size").isNull(), F.col("run_keep")).otherwise(F.col("all_keep")))
    first_of_null = F.col("keep").isNull() & F.col("id").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("leads") & (F.col("id").eqNullSafe(F.col("keep")) | first_of_null)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
