"""Sorting, top-k and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ingress import materialised

#: Rows of a top-k that may be merged in one task, and values of a bracket that may be sorted in one.
MANY, FEW = 10000, 1 << 16
#: Quantiles taken from the first sketch, and 1 / the error of every sketch.
STEPS, ACCURACY = 1000, 10000


def sorted_ranks(vec: DataFrame, descending: bool = False, parts: int | None = None) -> DataFrame:
    """``idx, v, rank`` from 1; equal values by index. NaN is the greatest."""
    return _placed(vec.select("idx", "v"), [F.col("v").desc() if descending else F.col("v").asc(), F.col("idx").asc()], parts)


def _placed(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` with ``rank`` from 1 in ``order``.

    One shuffle: rows are range-partitioned and sorted; a row's rank is its
    place in its range, which is the low half of its
    ``monotonically_increasing_id``, plus the sizes of the ranges before, of
    which there is one row for each range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialised(placed.select(*df.columns, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select(*df.columns, (F.col("start") + F.col("place") + 1).alias("rank"))


def sort_values(vec: DataFrame, descending: bool = False) -> DataFrame:
    return vec.orderBy(F.col("v").desc() if descending else F.col("v").asc(), F.col("idx").asc())


def strided_exactly(vec: DataFrame, n: int, s: int) -> DataFrame:
    """``s`` of the ``n`` elements 0 to n - 1 of a vector: those at ``i * n div s``."""
    i = F.expr(f"(idx * {s} + {n} - 1) div {n}")  # the only one that can point here
    return vec.filter((i < s) & (F.expr(f"((idx * {s} + {n} - 1) div {n}) * {n} div {s}") == F.col("idx")))


def strided(vec: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th element of a vector, by its index."""
    return vec.filter(F.pmod("idx", F.lit(stride)) == 0)


def topk(df: DataFrame, value: str, k: int, *payload: str, largest: bool = True) -> DataFrame:
    """The k largest (or least) rows in order, duplicates kept, ties by ``payload``; all rows where there are fewer.

    Few rows are kept in each task and merged. More than ``MANY`` are cut off
    at the k-th value, found by ``order_statistics``, and range-sorted, so no
    task holds k rows.
    """
    first = F.col(value).desc() if largest else F.col(value).asc()
    order = [first, *[F.col(p).asc() for p in payload]]
    rows = df.select(value, *payload)
    if k <= MANY:
        return rows.orderBy(*order).limit(max(k, 0))
    cut = order_statistics(rows, value, [k], largest).first()["value"]
    if cut is not None:
        near = F.col(value) >= F.lit(cut) if largest else F.col(value) <= F.lit(cut)
        known, nulls = rows.filter(near), F.col(value).isNull()
        # Nulls are last of the largest, and first of the least.
        rows = known.union(rows.filter(nulls)) if rows.filter(nulls).limit(1).count() else known
    placed = _placed(rows, order)
    return placed.filter(F.col("rank") <= k).orderBy("rank").select(value, *payload)


def topk_grouped(df: DataFrame, key: str, value: str, k: int, tie: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(value).desc(), F.col(tie).asc()))
    return df.select(key, value, tie, rank.alias("rank")).filter(F.col("rank") <= k)


def order_statistics(df: DataFrame, value: str, ranks: list[int], largest: bool = True) -> DataFrame:
    """``rank, value``: the values at several ranks from 1 of a number column; exact, and no task holds more than ``FEW`` of them.

    One pass makes a mergeable quantile sketch that gives every rank a bracket,
    one counts what lies below and in each, and both go on inside a bracket
    until it holds one value or at most ``FEW``, which are sorted. A bracket that misses
    its rank is moved by the counts. Nulls take no part, NaN is the greatest;
    a rank beyond the number of values gives the last one, no values null; a rank
    asked twice comes twice.
    """
    spark, kind = df.sparkSession, df.schema[value].dataType
    v = F.col("v")
    known = df.select(F.col(value).alias("v")).filter(v.isNotNull())
    sound = ~F.isnan(v) if kind.typeName() in ("double", "float") else F.lit(True)
    head = known.agg(F.count(F.lit(1)).alias("all"), F.count_if(sound).alias("n"), F.min(F.when(sound, v)).alias("lo"), F.max(F.when(sound, v)).alias("hi"), F.percentile_approx(F.when(sound, v), [i / STEPS for i in range(STEPS + 1)], ACCURACY).alias("q")).first()
    known = known.filter(sound)
    wanted = {r: (lambda at: head["all"] - at + 1 if largest else at)(min(max(r, 1), head["all"])) for r in ranks}
    # For each place from below: bracket, values under it, values in it.
    at = {a: (head["lo"], head["hi"], 0, head["n"]) for a in wanted.values() if 0 < a <= head["n"]}
    place = {a: int((a - 0.5) / head["n"] * STEPS) for a in at}
    cuts = {a: (head["q"][max(i - 1, 0)], head["q"][min(i + 2, STEPS)]) for a, i in place.items()}
    while wide := {a: x for a, x in at.items() if x[0] != x[1] and x[3] > FEW}:
        within = {a: v.between(F.lit(x[0]), F.lit(x[1])) for a, x in wide.items()}
        if cuts is None:
            share = {a: (a - x[2] - 0.5) / x[3] for a, x in wide.items()}
            row = known.agg(*[F.percentile_approx(F.when(within[a], v), [max(0.0, s - 2 / ACCURACY), min(1.0, s + 2 / ACCURACY)], ACCURACY).alias(str(a)) for a, s in share.items()]).first()
            cuts = {a: tuple(row[str(a)]) for a in wide}
        sums = [F.count_if(within[a] & c).alias(f"{a} {n}") for a in wide for n, c in enumerate(c for x in cuts[a] for c in (v < F.lit(x), v <= F.lit(x)))]
        counts = known.agg(*sums).first()
        for a, (lo, hi, below, n) in wide.items():
            (x, y), (lt_x, le_x, lt_y, le_y), r = cuts[a], [counts[f"{a} {c}"] for c in range(4)], a - below
            if r <= lt_x:
                at[a] = lo, x, below, le_x
            elif r <= le_x:
                at[a] = x, x, below + lt_x, le_x - lt_x
            elif r <= lt_y:
                at[a] = x, y, below + lt_x, le_y - lt_x
            elif r <= le_y:
                at[a] = y, y, below + lt_y, le_y - lt_y
            else:
                at[a] = y, hi, below + lt_y, n - lt_y
        cuts = None
        if all(at[a] == x for a, x in wide.items()):
            break  # values that the sketch cannot tell apart
    found = {}
    for a, (lo, hi, below, n) in at.items():
        inside = known.filter(v.between(F.lit(lo), F.lit(hi)))
        if lo == hi:
            found[a] = lo
        elif n <= FEW:
            found[a] = inside.orderBy("v").offset(a - below - 1).limit(1).first()[0]
        else:
            found[a] = _placed(inside, [v.asc()]).filter(F.col("rank") == a - below).first()["v"]
    nan = float("nan")
    rows = [(r, None if not head["all"] else found.get(wanted[r], nan)) for r in ranks]
    return spark.createDataFrame(rows, T.StructType([T.StructField("rank", T.LongType()), T.StructField("value", kind)]))


def kth_largest(df: DataFrame, value: str, k: int) -> DataFrame:
    """``kth``: the k-th largest value; the least of all where there are fewer."""
    if k > MANY:
        return order_statistics(df, value, [k]).select(F.col("value").alias("kth"))
    return topk(df, value, k).agg(F.min(value).alias("kth"))


def survivors(df: DataFrame, value: str, k: int) -> DataFrame:
    """``n, kth``: how many values are above the k-th largest, and that value; in one plan, no value passes through the driver."""
    kth = kth_largest(df, value, k)
    return df.select(value).join(F.broadcast(kth), F.col(value) > F.col("kth"), "right").groupBy("kth").agg(F.count(value).alias("n"))
