"""Literal cases, edge cases and identities of the numeric operators."""

import math
import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import random as R
from tallyforge.functions import scalar as S
from tallyforge.operators import image, linalg, neighbors, neural, order, reduce, scan
from tallyforge.sources import ingress
from tallyforge.streaming.topk import StreamingTopK
from tallyforge.streaming.windows import drained, windowed_topk


def matrix(spark, rows):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i long, j int, v double")


def dense(df):
    cells = {(r["i"], r["j"]): r["v"] for r in df.collect()}
    n, m = max(i for i, _ in cells) + 1, max(j for _, j in cells) + 1
    return [[cells[i, j] for j in range(m)] for i in range(n)]


def vec(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, v double")


def mapped(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", f(F.col("v")).alias("y"))
    return [r["y"] for r in df.orderBy("i").collect()]


def test_batch_norm(spark):
    params = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 0.0)], "j int, gamma double, beta double")
    got = dense(neural.batch_norm(matrix(spark, [[1, 2], [3, 4], [5, 6]]), params))
    for row, want in zip(got, (-1.2247426, 0.0, 1.2247426), strict=True):
        assert row == pytest.approx([want, want], abs=1e-6)


def test_count_equal(spark):
    values = [1, 2, 3, 4, 5, 1, 1, 1, 1, 2, 2, 2]
    assert reduce.count_equal(spark.createDataFrame([(v,) for v in values], "v int"), F.col("v"), 1).first()[0] == 5


def test_interleave(spark):
    got = linalg.interleave(vec(spark, [1, 2, 3]), vec(spark, [4, 5, 6])).orderBy("idx").collect()
    assert [r["v"] for r in got] == [1, 4, 2, 5, 3, 6]


def test_gemm(spark):
    a, b, c = matrix(spark, [[1, 2, 3], [4, 5, 6]]), matrix(spark, [[1, 2], [3, 4], [5, 6]]), matrix(spark, [[1, 1], [1, 1]])
    assert dense(linalg.gemm(a, b, c, 1.0, 0.0)) == [[22, 28], [49, 64]]
    assert dense(linalg.gemm(a, b, c, 2.0, 0.5)) == [[44.5, 56.5], [98.5, 128.5]]


def test_attention_rows_sum_from_values(spark):
    q = matrix(spark, [[1, 0], [0, 1]])
    k = matrix(spark, [[1, 0], [0, 1], [1, 1]])
    v = matrix(spark, [[1, 2], [3, 4], [5, 6]])
    got = dense(linalg.attention(q, k, v, 2))
    for row, scores in zip(got, ((1, 0, 1), (0, 1, 1)), strict=True):
        w = [math.exp(s / math.sqrt(2)) for s in scores]
        assert row == pytest.approx([sum(x * y for x, y in zip(w, col, strict=True)) / sum(w) for col in ((1, 3, 5), (2, 4, 6))])


def test_topk_small(spark):
    values = [3.5, 1.2, 9.8, -2.1, 4.4, 7.0, -0.5, 10.1, 0.0, 6.3]
    assert [r["v"] for r in order.topk(vec(spark, values), "v", 5).collect()] == [10.1, 9.8, 7.0, 6.3, 4.4]
    assert [r["v"] for r in order.topk(vec(spark, values), "v", 3, largest=False).collect()] == [-2.1, -0.5, 0.0]
    assert order.topk(vec(spark, values), "v", 0).count() == 0
    assert order.topk(vec(spark, values), "v", 99).count() == 10


CASES = {
    "uniform": (20_000, 50, lambda r: r.uniform(0, 1)), "wide": (20_000, 100, lambda r: r.uniform(-1e5, 1e5)), "ties": (20_000, 40, lambda r: r.choice([-10, -2.5, 0, 3.14, 5, 7.7, 9.9, 42])),
    "same": (5_000, 20, lambda r: 7.777), "one": (20_000, 1, lambda r: r.uniform(-500, 500)), "all": (256, 256, lambda r: r.uniform(-10, 10)), "gauss": (20_003, 100, lambda r: r.gauss(0, 1)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_topk_cases(spark, name):
    n, k, draw = CASES[name]
    r = random.Random(n)
    values = [draw(r) for _ in range(n)]
    want = sorted(values, reverse=True)[:k]
    df = vec(spark, values)
    assert [x["v"] for x in order.topk(df, "v", k).collect()] == want
    assert order.kth_largest(df, "v", k).first()[0] == want[-1]
    assert order.survivors(df, "v", k).first()["n"] == sum(v > want[-1] for v in values)


def test_prefix_sum(spark):
    ones = ingress.constant(spark, 5000)
    assert all(r["total"] == r["idx"] + 1 for r in scan.prefix_sum(ones, block=64).collect())
    assert all(r["total"] == r["idx"] for r in scan.prefix_sum(ones, inclusive=False, block=7).collect())
    assert all(r["total"] == r["idx"] % 1024 for r in scan.block_prefix_sum(ones).collect())


def test_block_sum(spark):
    got = {r["block"]: r["total"] for r in reduce.block_sum(ingress.iota(spark, 65536)).collect()}
    assert got == {b: 1024 * (1024 * b) + 523776 for b in range(64)}


def test_sorted_ranks_both_ways(spark):
    values = [random.Random(5).choice([1.0, 2.0, 3.5, -7.0]) for _ in range(300)] + [math.nan]
    for down in (False, True):
        got = {r["idx"]: r["rank"] for r in order.sorted_ranks(vec(spark, values), down).collect()}
        key = [math.inf if math.isnan(v) else v for v in values]
        want = sorted(range(len(values)), key=lambda i: (-key[i] if down else key[i], i))
        assert [got[i] for i in want] == list(range(1, len(values) + 1))


def test_nan_rules(spark):
    nan = float("nan")
    assert mapped(spark, [nan, -1.0, 2.0], S.relu) == [0, 0, 2]
    assert mapped(spark, [nan, -1.0, 2.0], S.leaky_relu_split) == [0, -0.01, 2]
    assert math.isnan(mapped(spark, [nan], S.leaky_relu)[0])
    assert mapped(spark, [nan, -9.0, 9.0, 0.5], lambda x: S.clip(x, -1, 1)) == [-1, -1, 1, 0.5]
    assert mapped(spark, [5.0, -5.0], lambda x: S.clip(x, 2, 1)) == [1, 1]


def test_gelu_and_sigmoid(spark):
    values = [-3.0, -0.5, 0.0, 0.7, 4.0, None]
    for got, x in zip(mapped(spark, values, S.gelu), values, strict=True):
        assert got is None if x is None else got == pytest.approx(0.5 * x * (1 + math.erf(x / math.sqrt(2))))
    assert mapped(spark, [-800.0, 800.0], S.sigmoid) == [0.0, 1.0]


def test_float_order_key(spark):
    values = [-math.inf, -3.5, -1e-30, 0.0, 1e-30, 2.0, math.inf]
    keys = mapped(spark, values, S.float_order_key)
    assert keys == sorted(keys) and len(set(keys)) == len(keys) and keys[0] >= 0


def test_next_pow2_and_ceil_div(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 70)], "n long").select("n", S.next_pow2(F.col("n")).alias("p"), S.ceil_div(F.col("n"), F.lit(8)).alias("c"))
    for n, p, c in df.collect():
        assert p == 1 << (n - 1).bit_length() and c == -(-n // 8)


def test_geglu_odd_width(spark):
    got = neural.geglu(matrix(spark, [[1, 2, 3, 4, 5]]), 5).orderBy("j").collect()
    assert [r["v"] for r in got] == pytest.approx([x * 0.5 * g * (1 + math.erf(g / math.sqrt(2))) for x, g in ((1, 3), (2, 4))])


def test_softmax_rows(spark):
    got = dense(neural.softmax(matrix(spark, [[1000.0, 1001.0], [-5.0, -5.0]])))
    assert got[0] == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)]) and got[1] == [0.5, 0.5]


def test_cross_entropy_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 0.0], 0), ([0.0, 0.0], 1)], "z array<double>, y int")
    assert reduce.cross_entropy(df, F.col("z"), F.col("y")).first()[0] == pytest.approx(math.log(2) / 2)


def test_spmv_keeps_empty_rows(spark):
    a = matrix(spark, [[0, 2], [0, 0], [3, 4]])
    x = spark.createDataFrame([(0, 1.0), (1, 10.0)], "j int, x double")
    got = linalg.spmv(a, x, spark.range(3).select(F.col("id").alias("i"))).orderBy("i").collect()
    assert [r["y"] for r in got] == [20, 0, 43]


def test_histogram_ignores_what_is_outside(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 0, 2, 5, None)], "v int")
    assert [r["cnt"] for r in reduce.histogram(df, F.col("v"), 4).orderBy("bin").collect()] == [2, 0, 1, 0]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "idx long, v double")
    assert reduce.total(none, F.col("v")).first()[0] == 0
    assert reduce.subarray_sum(none, 0, 5).first()[0] == 0
    assert scan.prefix_sum(none).count() == 0
    assert order.sorted_ranks(none).count() == 0


def brute_nn(points):
    out = {}
    for i, p in points.items():
        others = [(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for j, q in points.items() if j != i]
        out[i] = min(others)[1] if others else -1
    return out


@pytest.mark.parametrize("kind", ["spread", "far", "clumps", "one", "two", "line"])
def test_nearest_neighbour(spark, kind):
    r = random.Random(kind)
    if kind in ("spread", "far"):
        pts = {i: (r.random(), r.random(), r.random()) for i in range(200)}
        if kind == "far":
            pts |= {7: (1e6, 1e6, 1e6), 8: (-1e15, 0.0, 0.0)}
    elif kind == "clumps":
        pts = {i: (round(r.gauss(0, 1e-3), 3) + (i % 3) * 50, round(r.random(), 1), 0.0) for i in range(150)}
    elif kind == "line":
        pts = {i: (float(i * i), 1.0, 1.0) for i in range(40)}
    else:
        pts = {i: (float(i), 0.0, 0.0) for i in range(1 if kind == "one" else 2)}
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "idx long, x double, y double, z double")
    assert dict(neighbors.nearest_neighbour(df).collect()) == brute_nn(pts)


@pytest.mark.parametrize("kind", ["even", "two clumps", "a fifth far"])
def test_nearest_neighbour_over_many_leaves(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbors, "LEAF", 16)
    monkeypatch.setattr(neighbors, "DRAWN", 1500)
    r = np.random.default_rng(len(kind))
    p = r.random((3000, 3))
    if kind == "two clumps":
        p[:2000] = p[:2000] * 1e-6 + 5
    elif kind == "a fifth far":
        p[::5] = r.normal(size=(600, 3)) * 10.0 ** r.integers(2, 9, (600, 1))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "idx long, x double, y double, z double")
    tree, dealt = neighbors._tree(df, len(p))
    loads = [x["count"] for x in dealt.groupBy("leaf").count().collect()]
    assert sum(loads) == len(p) and max(loads) <= 16 * neighbors.OVER and len(loads) > 50
    d = sum((p[:, None, c] - p[None, :, c]) ** 2 for c in range(3))
    np.fill_diagonal(d, np.inf)
    assert dict(neighbors.nearest_neighbour(df).collect()) == dict(enumerate(d.argmin(axis=1)))


def test_nearest_neighbour_leaves_nan_out(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, float("nan"), 0.0, 0.0), (2, 5.0, 0.0, 0.0), (3, None, 0.0, 0.0)], "idx long, x double, y double, z double")
    assert dict(neighbors.nearest_neighbour(df).collect()) == {0: 2, 1: -1, 2: 0, 3: -1}


def test_correlate(spark):
    pixels = spark.createDataFrame([(0, r, c, float(r * 3 + c)) for r in range(3) for c in range(3)], "img int, r int, c int, v double")
    kernel = [[0, 1, 0], [0, 0, 2], [0, 0, 0]]
    got = {(x["r"], x["c"]): x["v"] for x in image.correlate(pixels, kernel, 3, 3).collect()}
    at = lambda r, c: r * 3 + c if 0 <= r < 3 and 0 <= c < 3 else 0
    assert got == {(r, c): at(r - 1, c) + 2 * at(r, c + 1) for r in range(3) for c in range(3)}
    with pytest.raises(ValueError):
        image.correlate(pixels, [[1, 1]], 3, 3)


@pytest.mark.parametrize(("rows", "cols", "k", "side"), [(13, 9, (3, 5), 4), (30, 41, (21, 21), 8), (5, 5, (1, 1), 2), (40, 40, (7, 3), 256)])
def test_correlate_over_tiles(spark, rows, cols, k, side):
    r = np.random.default_rng(rows)
    images, kernel = r.normal(size=(3, rows, cols)), r.normal(size=k)
    pixels = spark.createDataFrame([(i, y, x, float(v)) for i, im in enumerate(images) for y, row in enumerate(im) for x, v in enumerate(row)], "img int, r int, c int, v double").repartition(3)
    got = np.full(images.shape, np.nan)
    for p in image.correlate(pixels, kernel.tolist(), rows, cols, side).collect():
        assert np.isnan(got[p["img"], p["r"], p["c"]])
        got[p["img"], p["r"], p["c"]] = p["v"]
    wide = np.pad(images, ((0, 0), (k[0] // 2,) * 2, (k[1] // 2,) * 2))
    want = sum(kernel[m, n] * wide[:, m : m + rows, n : n + cols] for m in range(k[0]) for n in range(k[1]))
    assert np.allclose(got, want, atol=1e-12)


def test_correlate_of_few_pixels(spark):
    pixels = spark.createDataFrame([("a", 3, 4, 2.0), (None, 0, 0, None), ("a", 90, 1, 1.0)], "img string, r long, c long, v double")
    got = {(x["img"], x["r"], x["c"]): x["v"] for x in image.correlate(pixels, [[1, 2, 3]] * 3, 20, 20, 4).collect()}
    assert got == {("a", r, c): 2.0 * (5 - c + 1) for r in (2, 3, 4) for c in (3, 4, 5)} | {(None, r, c): 0.0 for r in (0, 1) for c in (0, 1)}


def test_correlate_moves_a_pixel_once(spark):
    pixels = spark.range(300 * 300).select(F.lit(0).alias("img"), F.expr("int(id div 300)").alias("r"), (F.col("id") % 300).cast("int").alias("c"), F.lit(1.0).alias("v"))
    out = image.correlate(pixels, [[1.0] * 21] * 21, 300, 300)
    out.write.format("noop").mode("overwrite").save()
    assert out.agg(F.count(F.lit(1)), F.max("v"), F.min("v")).first()[:] == (90000, 441.0, 121.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "SortMergeJoin" not in plan


def test_spmv_with_a_hub(spark):
    r = np.random.default_rng(2)
    i, j = r.integers(0, 400, 3000), r.integers(0, 300, 3000)
    j[::3], i[1::3] = 7, 11
    v = r.normal(size=3000)
    v[::50] = 0
    x = r.normal(size=300)
    cells = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(i, j, v, strict=True)], "i long, j int, v double").repartition(4)
    xs = spark.createDataFrame([(k, float(t)) for k, t in enumerate(x)], "j int, x double")
    want = np.bincount(i, v * x[j], 401)
    got = dict(linalg.spmv(cells, xs, spark.range(401).withColumnRenamed("id", "i")).collect())
    assert sorted(got) == list(range(401)) and np.allclose([got[k] for k in range(401)], want, atol=1e-12)
    assert linalg.spmv(cells.limit(0), xs, spark.range(2).withColumnRenamed("id", "i")).collect() == [(0, 0.0), (1, 0.0)]


def test_sample_of_exactly_so_many(spark):
    for n, s in ((10, 3), (1000, 137), (7, 7), (12, 5)):
        got = [r["idx"] for r in order.strided_exactly(ingress.iota(spark, n), n, s).orderBy("idx").collect()]
        assert got == [i * n // s for i in range(s)]


def test_windows_of_a_stream_with_late_rows_and_a_restart(spark, tmp_path):
    schema = "kind string, at timestamp_ntz, v double, id long"
    day = lambda *rows: [(kind, datetime(2024, 1, d, h), v, i) for kind, d, h, v, i in rows]
    days = [
        day(("a", 1, 1, 5.0, 1), ("a", 1, 2, 9.0, 2), ("a", 1, 3, 9.0, 3), ("b", 1, 4, 1.0, 4), (None, 1, 4, 1.0, 5)) + [("a", None, 99.0, 90), ("a", datetime(2024, 1, 1), None, 91)],
        day(("a", 2, 0, 7.0, 6), ("a", 1, 23, 11.0, 7)),  # in time: the first day is open
        day(("a", 3, 5, 2.0, 8)),  # closes the first and the second day
        day(("a", 1, 5, 100.0, 9), ("b", 3, 6, 4.0, 10)),  # too late for the first day
        day(("b", 5, 0, 0.0, 11)),
    ]

    def run(n):
        spark.createDataFrame(days[n], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        rows = windowed_topk(stream, "kind", "at", "v", "id", 2, 86400, 3600)
        first = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())
        return sorted((r["key"], (r["start"] - first) // 86400, r["rank"], r["value"], r["tie"]) for r in drained(spark, rows, str(tmp_path / "out")).collect())

    assert run(0) == [] and run(1) == []
    closed = [("", 0, 1, 1.0, 5), ("a", 0, 1, 11.0, 7), ("a", 0, 2, 9.0, 2), ("a", 1, 1, 7.0, 6), ("b", 0, 1, 1.0, 4)]
    assert run(2) == closed and run(3) == closed
    assert run(4) == sorted([*closed, ("a", 2, 1, 2.0, 8), ("b", 2, 1, 4.0, 10)])


def test_identities(spark):
    e = matrix(spark, [[1, 2, 3], [4, 5, 6]])
    assert dense(linalg.transpose(linalg.transpose(e))) == dense(e)
    assert ingress.rows(e).orderBy("i").collect()[1]["vals"] == [4, 5, 6]


def test_generators(spark):
    u = ingress.uniform(spark, 5000, -100, 100, 1).agg(F.min("v"), F.max("v")).first()
    assert -100 <= u[0] < -90 and 90 < u[1] < 100
    n = ingress.normal(spark, 20000, 2).agg(F.avg("v"), F.stddev("v"), F.kurtosis("v")).first()
    assert abs(n[0]) < 0.03 and abs(n[1] - 1) < 0.03 and abs(n[2]) < 0.2
    assert {r["v"] for r in ingress.choice(spark, 500, [1, 2, 3], 3).collect()} == {1.0, 2.0, 3.0}


def test_generators_do_not_depend_on_partitions(spark):
    for column in (R.uniform_at(F.col("id"), 5, -3.0, 8.0), R.normal_at(F.col("id"), 5), R.choice_at(F.col("id"), 5, [1.0, 4.0])):
        one, other = (dict(spark.range(0, 3000, 1, parts).select("id", column.alias("v")).collect()) for parts in (1, 7))
        assert one == other
        assert dict(spark.range(2990, 3000).select("id", column.alias("v")).collect()).items() <= one.items()
    a, b = (np.array([r["v"] for r in ingress.uniform(spark, 4000, 0, 1, seed).orderBy("idx").collect()]) for seed in (1, 2))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.06 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.06
    assert np.histogram(a, 10, (0, 1))[0].min() > 320


def test_erf_in_plain_arithmetic(spark):
    x = [*np.linspace(-7, 7, 4001).tolist(), *[s * e for s in (1, -1) for e in (0.0, 1e-300, 1e-9, 0.46875, 0.468750001, 4.0, 4.0000001, 6.0, 30.0, math.inf)]]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", S.erf(F.col("x")).alias("y"))
    assert max(abs(math.erf(r["x"]) - r["y"]) for r in df.collect()) < 2e-15
    assert spark.createDataFrame([(None,)], "x double").select(S.erf(F.col("x"))).first()[0] is None
    assert math.isnan(spark.createDataFrame([(math.nan,)], "x double").select(S.erf(F.col("x"))).first()[0])
    assert "reflect" not in df._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("kind", ["even", "ties", "normal", "sorted", "longs", "far"])
def test_order_statistics(spark, monkeypatch, kind):
    monkeypatch.setattr(order, "FEW", 40)
    monkeypatch.setattr(order, "ACCURACY", 100)
    monkeypatch.setattr(order, "STEPS", 20)
    r = np.random.default_rng(len(kind))
    x = {"even": r.uniform(-1000, 1000, 9000), "ties": r.choice([-10.0, 3.14, 5.0, 42.0], 9000), "normal": r.normal(size=9000), "sorted": np.arange(9000.0), "longs": r.integers(2**62, 2**62 + 5000, 9000), "far": np.append(r.normal(size=8990), 10.0 ** np.arange(290, 300))}[kind]
    plain = sorted(x.tolist(), reverse=True)
    ranks = [1, 2, 50, 4500, 8999, 9000, 20000]
    rows = [(int(v),) if kind == "longs" else (float(v),) for v in x] + [(None,)] * 3
    df = spark.createDataFrame(rows, f"v {'long' if kind == 'longs' else 'double'}").repartition(5)
    assert [tuple(r) for r in order.order_statistics(df, "v", ranks).orderBy("rank").collect()] == [(k, plain[min(k, 9000) - 1]) for k in ranks]
    assert [r["value"] for r in order.order_statistics(df, "v", [1, 70], largest=False).orderBy("rank").collect()] == [plain[-1], plain[-70]]


def test_order_statistics_of_nan_and_nothing(spark):
    df = spark.createDataFrame([(math.nan,), (2.0,), (None,), (1.0,), (math.nan,)], "v double")
    got = [r["value"] for r in order.order_statistics(df, "v", [1, 2, 3, 4, 9]).orderBy("rank").collect()]
    assert math.isnan(got[0]) and math.isnan(got[1]) and got[2:] == [2.0, 1.0, 1.0]
    assert order.order_statistics(df.limit(0), "v", [1]).first()["value"] is None
    assert order.order_statistics(df, "v", [3, 3, 4]).count() == 3


@pytest.mark.parametrize("largest", [True, False])
def test_topk_of_many_rows(spark, monkeypatch, largest):
    monkeypatch.setattr(order, "MANY", 10)
    monkeypatch.setattr(order, "FEW", 30)
    rows = [(i, float(i * 37 % 50)) for i in range(2000)] + [(5000, None), (5001, None)]
    df = spark.createDataFrame(rows, "id long, v double")
    key = lambda x: ((x[1] is None) if largest else (x[1] is not None), (-(x[1] or 0) if largest else (x[1] or 0)), x[0])
    for k in (11, 1000, 2001, 5000):
        assert [(r["id"], r["v"]) for r in order.topk(df, "v", k, "id", largest=largest).collect()] == sorted(rows, key=key)[:k]
    assert order.kth_largest(df, "v", 1000).first()["kth"] == sorted((v for _, v in rows if v is not None), reverse=True)[999]


def test_softmax_terms_of_any_size(spark):
    x = [[1000.0, 1000.5, -2000.0], [-1e5, -1e5 - 1, -1e6], [1e8, 3.0, -1e8], [511.9999, 512.0, 512.0001], [0.0, -800.0, 600.0]]
    got = {r["i"]: (r["top"], r["total"]) for r in reduce.row_softmax_terms(matrix(spark, x)).collect()}
    for i, row in enumerate(x):
        assert got[i][0] == max(row) and got[i][1] == pytest.approx(sum(math.exp(v - max(row)) for v in row), rel=1e-12)
    plan = neural.softmax(matrix(spark, x))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2  # once for the terms, once for the result


def test_streaming_topk_over_batches(spark, tmp_path):
    rows = [(i, float((i * 37) % 101)) for i in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], "id long, v double").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema("id long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = StreamingTopK(spark, str(tmp_path / "out"), "v", 7, "id").run(stream).collect()
    assert [(r["v"], r["id"]) for r in got] == sorted(((v, i) for i, v in rows), key=lambda x: (-x[0], x[1]))[:7]


def test_streaming_topk_goes_on_after_a_restart(spark, tmp_path):
    schema = "id long, v double"
    for day, rows in enumerate(([(1, 5.0), (2, 9.0), (3, 1.0)], [(4, 7.0), (5, 0.0)], [])):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={day}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        got = StreamingTopK(spark, str(tmp_path / "out"), "v", 2, "id").run(stream).collect()
        assert [r["id"] for r in got] == ([2, 1] if not day else [2, 4])
