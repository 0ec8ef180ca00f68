"""Line deduplication over windows of three lines (DataFrame operations only).

Every three consecutive lines of a document are a window. Windows that occur
more than once in the corpus are found by a 128-bit hash of their lines; each
line that a later occurrence covers is removed, the first occurrence (smallest
id, then hash of the text, then position) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, stored

WIDTH = 3


def _body(text_col: str) -> Column:
    """What tells texts of one id apart, in an order that every engine has."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("body")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body, at): windows starting at line ``at`` (from 0) that repeat an earlier one."""
    lines = docs.select(F.col(id_col).alias("id"), _body(text_col), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))
    lines = lines.filter(F.size("lines") >= WIDTH)
    joined = lambda i: F.array_join(F.slice(F.col("lines"), i + 1, WIDTH), "\n")
    wins = lines.select("id", "body", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - WIDTH), lambda i: F.struct(i.alias("at"), joined(i).alias("win")))).alias("w"))
    wins = wins.select("id", "body", "w.at", "w.win").filter(F.trim(F.replace("win", F.lit("\n"), F.lit(" "))) != "")
    wins = stored(wins.select(F.unhex(F.md5("win")).alias("hash"), "id", "body", "at"), "line-windows")
    # Map-side partial aggregation keeps a window that every document has to one row for each task.
    place = F.struct("id", "body", "at")
    first = stored(wins.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "line-first")
    return join_counted(wins, first, ["hash"], "n").filter(place > F.col("first")).select("id", "body", "at")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``id_col``, ``clean_text``, ``n_lines``, ``n_removed``.

    Lines end at LF. A window of blank lines alone never counts. Documents of
    fewer than three lines stay whole; null text is empty (one empty line). A
    row repeated with the same id and text is the same document and loses
    nothing to itself; rows with one id and different texts are apart and
    ordered by a hash of the text. Rows with a null id sort first. Texts of any
    number of lines are taken whole. An empty table gives an empty result;
    other columns are not looked at.
    """
    found = repeated_windows(docs, id_col, text_col).groupBy("id", "body").agg(F.collect_set("at").alias("starts"))
    base = docs.select(F.col(id_col).alias("id"), _body(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = found.select(F.col("id").alias("fid"), F.col("body").alias("fbody"), "starts")
    rows = base.join(found, base["id"].eqNullSafe(F.col("fid")) & (base["body"] == F.col("fbody")), "left")
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + WIDTH - 1)))
    rows = rows.withColumn("lines", F.split("text", "\n", -1))
    # The places that no window covers, in order; one pass with a hash set, however long the text.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    rows = rows.withColumn("stay", F.when(F.col("starts").isNotNull(), stay))
    rest = F.transform("stay", lambda i: F.get("lines", i))
    gone = F.when(F.col("stay").isNull(), 0).otherwise(F.size("lines") - F.size("stay"))
    return rows.select(F.col("id").alias(id_col), F.when(F.col("stay").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("clean_text"), F.size("lines").cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"))
