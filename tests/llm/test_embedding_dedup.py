"""Embedding near-duplicates against the cosines of all pairs."""

import math

import numpy as np
import pytest

from tallyforge.llm import embedding_dedup as E

VECTORS = "vec_id long, embedding array<float>, label int"


def all_pairs(rows, threshold=0.95):
    """(id, links, component, kept) with every cosine computed; ids may repeat or be null."""

    def sound(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    n, up = len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    widths = {len(v) for _, v in rows if sound(v)}
    for width in widths:
        at = [i for i, (_, v) in enumerate(rows) if sound(v) and len(v) == width]
        x = np.array([rows[i][1] for i in at], dtype=np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for p, q in zip(*np.nonzero(np.triu(x @ x.T >= threshold - 1e-13, 1)), strict=True):
            links[at[p]] += 1
            links[at[q]] += 1
            up[top(at[p])] = top(at[q])
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[top(i)] = min(v, least.get(top(i), v))
    out = [(v, links[i], least.get(top(i))) for i, (v, _) in enumerate(rows)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=repr)


def found(df, **more):
    return sorted(map(tuple, E.embedding_duplicates(df, **more).collect()), key=repr)


def clustered(seed, n, width, spread):
    """Unit vectors in groups about common middles, so that many cosines lie on both sides of the threshold."""
    r = np.random.default_rng(seed)
    middles = r.normal(size=(max(1, n // 12), width))
    x = middles[r.integers(0, len(middles), n)] + spread * r.normal(size=(n, width))
    return (x * r.uniform(0.01, 100, (n, 1))).astype(np.float32)


@pytest.mark.parametrize(("width", "tile"), [(64, 64), (64, 2048), (3, 32), (40, 16)])
def test_links_equal_all_pairs(spark, monkeypatch, width, tile):
    monkeypatch.setattr(E, "TILE", tile)
    rows = [(i * 3, v.tolist()) for i, v in enumerate(clustered(width, 400, width, 0.22))]
    got = found(spark.createDataFrame([(*r, 0) for r in rows], VECTORS).repartition(5))
    assert got == all_pairs(rows)
    assert sum(r[1] for r in got) > 300 and any(r[1] for r in got) and not all(r[1] for r in got)


def test_messy_vectors(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 8)
    x = clustered(5, 40, 6, 0.1).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(100, None), (101, []), (102, [0.0] * 6), (103, [1.0, None] * 3), (104, [float("nan")] + [1.0] * 5), (105, [float("inf")] + [1.0] * 5)]
    rows += [(106, x[0]), (106, x[1]), (106, x[0]), (None, x[2]), (None, [9.0, -9.0, 9.0, -9.0, 9.0, -8.0]), (107, [-0.0, 1.0, 0.0]), (108, [0.0, 2.0, 0.0]), (109, [1e-30, 2e-30] + [0.0] * 4), (110, [1e30, 2e30] + [0.0] * 4)]
    rows += [(111, x[3])] * 50
    df = spark.createDataFrame([(*r, None) for r in rows], VECTORS).selectExpr("*", "1 as id", "2 as vec", "3 as class", "4 as m", "5 as n", "6 as root", "7 as tile")
    want = [(*r[:3], r[3] or r[2] is None) for r in all_pairs(rows)]
    assert found(df) == want
    assert found(df.limit(0)) == []
    assert found(df.filter("vec_id = 100")) == [(100, 0, 100, True)]


def test_double_precision_decides(spark):
    # 0.95 to within 1e-12 on either side.
    rows = [(0, [1.0, 0.0]), (1, [0.95 + 1e-12, math.sqrt(1 - (0.95 + 1e-12) ** 2)]), (2, [0.95 - 1e-12, -math.sqrt(1 - (0.95 - 1e-12) ** 2)])]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]


def test_copies_cost_nothing_and_tiles_out_of_reach_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 10)
    line = [(i, [math.cos(i / 100), math.sin(i / 100)]) for i in range(157)]
    tiles = E._tiled(spark.createDataFrame([(i, 1, v) for i, v in line], "class long, m long, vec array<float>"), np.eye(2), "<f4")
    pairs = E._meetings(tiles, 0.95).count()
    assert tiles.count() == 16 and 16 <= pairs < 16 * 17 // 2 * 0.6
    rows = line + [(1000 + i, line[0][1]) for i in range(60)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == all_pairs([(i, np.float32(v).tolist()) for i, v in rows])


def test_few_pairs_go_on_after_the_leading_axes():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 64))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    t = E._Tile(np.arange(600).tobytes(), np.ones(600, np.int64).tobytes(), x.tobytes(), axes, "<f8")
    bound = t.turned[:, :16] @ t.turned[:, :16].T + np.outer(t.behind[:, 16], t.behind[:, 16])
    assert (bound >= 0.95).mean() < 0.01 and (bound >= t.turned @ t.turned.T - 1e-12).all()
    i, j = E.linked(t, t, 0.95, E.STOPS)
    assert sorted(zip(i, j, strict=True)) == [(k, k) for k in range(600)]


def test_spanning_links_keep_components():
    r = np.random.default_rng(1)
    i, j = r.integers(0, 300, 200), r.integers(0, 300, 200)
    least = E._spanned(i, j, 300)
    up = list(range(300))
    for _ in range(300):
        for a, b in zip(i, j, strict=True):
            up[a] = up[b] = min(up[a], up[b])
    assert least.tolist() == up
