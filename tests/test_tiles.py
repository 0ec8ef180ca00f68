"""Dense products and attention by tiles, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import attention, linalg, tiles
from tallyforge.sources import ingress

CELLS = "i long, j int, v double"


def cells(spark, x):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], CELLS)


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r["i"], r["j"]])
        out[r["i"], r["j"]] = r["v"]
    return out


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 15), (9, 8, 16), (40, 3, 40)])
def test_product_of_ragged_tiles(spark, shape):
    r = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b, c = r.uniform(-1, 1, (m, k)), r.uniform(-1, 1, (k, n)), r.uniform(-1, 1, (m, n))
    side = 8
    product = tiles.multiply(tiles.tiles(cells(spark, a), side), tiles.tiles(cells(spark, b), side))
    assert np.allclose(dense(tiles.cells_of(product, side), (m, n)), a @ b, atol=1e-12)
    assert np.allclose(dense(linalg.gemm(cells(spark, a), cells(spark, b), cells(spark, c), 1.2, 0.8), (m, n)), 1.2 * a @ b + 0.8 * c, atol=1e-12)


def test_absent_rows_and_columns_stay_absent(spark):
    a = spark.createDataFrame([(3, 1, 2.0), (3, 700, 1.0), (900, 1, 5.0), (900, 2, None)], CELLS)
    b = spark.createDataFrame([(1, 4, 10.0), (700, 4, 3.0), (1, 600, 1.0), (5, 9, 1.0)], CELLS)
    got = {(r["i"], r["j"]): r["v"] for r in linalg.matmul(a, b).collect() if r["v"]}
    assert got == {(3, 4): 23.0, (900, 4): 50.0, (3, 600): 2.0, (900, 600): 5.0}
    assert linalg.matmul(a.limit(0), b).count() == 0


def test_a_product_of_two_thousand_by_two_thousand_moves_tiles(spark):
    n = 2000
    rows = lambda s: spark.range(n).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: ((F.col("id") * s + j * 7) % 11 - 5).cast("double")).alias("vals"))
    a, b = tiles.row_tiles(rows(3), "i", "vals"), tiles.row_tiles(rows(5), "i", "vals")
    assert tiles.multiply(a, b).count() == 64  # of 8 x 8 tiles, where cells would be 8e9 products
    got = {(r["i"], r["j"]): r["v"] for r in tiles.cells_of(tiles.multiply(a, b)).filter("i % 487 = 3 AND j % 389 = 1").collect()}
    i, j = np.arange(n)[:, None], np.arange(n)[None]
    want = ((i * 3 + j * 7) % 11 - 5.0) @ ((i * 5 + j * 7) % 11 - 5.0)
    assert got == {(x, y): want[x, y] for x in range(3, n, 487) for y in range(1, n, 389)}


def test_attention_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(attention, "ROWS", 16)
    monkeypatch.setattr(attention, "MEET", 2)
    r = np.random.default_rng(4)
    q, k, v = r.normal(size=(50, 6)) * 30, r.normal(size=(130, 6)) * 30, r.normal(size=(130, 3))
    asks = spark.createDataFrame([(i * 7, x.tolist()) for i, x in enumerate(q)], "i long, q array<double>")
    holds = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(k, v, strict=True))], "i long, k array<double>, v array<double>")
    s = q @ k.T / np.sqrt(6)
    w = np.exp(s - s.max(axis=1, keepdims=True))
    want = (w / w.sum(axis=1, keepdims=True)) @ v
    got = {r["i"]: r["vals"] for r in attention.attention_rows(asks, holds, 6).collect()}
    assert sorted(got) == [i * 7 for i in range(50)]
    assert np.allclose([got[i * 7] for i in range(50)], want, atol=1e-12)
    assert attention.attention_rows(asks, holds.limit(0), 6).count() == 0


def test_rows_of_arrays_equal_cells(spark):
    x = np.arange(30.0).reshape(5, 6)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, vals array<double>")
    a = tiles.cells_of(tiles.transposed(tiles.row_tiles(df, "i", "vals", 4)), 4)
    assert np.array_equal(dense(a, (6, 5)), x.T)
    assert np.array_equal(dense(tiles.cells_of(tiles.tiles(ingress.matrix(df, "i", "vals"), 4), 4), (5, 6)), x)
