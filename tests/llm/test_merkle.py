"""The Merkle manifest against trees built in plain Python."""

import random

import pytest

from tallyforge.llm import merkle, queries

from .helpers import DOCS, corpus, merkle as plain, messy, siblings, tree

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def found(spark, monkeypatch, df):
    monkeypatch.setattr(queries, "load", lambda *_: df)
    return sorted((tuple(r[c] for c in COLUMNS) for r in queries.op11_merkle_manifest(spark, "").collect()), key=repr)


def test_manifest_of_messy_rows(spark, monkeypatch):
    rows = corpus(4, 60)
    rows += [(None, "x", "en", "a", 1), (None, None, None, None, None), (7, rows[3][1], "en", "b", None), rows[5], rows[5], (2**62, "y" * 200000, "zz", "é", 2**63 - 1)]
    assert found(spark, monkeypatch, messy(spark, rows)) == sorted(plain(rows), key=repr)
    assert not found(spark, monkeypatch, messy(spark, []))


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (1024, 1025, 3), (4097, 0, 1, 2500)])
def test_trees_of_every_shape(spark, monkeypatch, sizes):
    rows = [(i * 10 + g, f"t{i}", f"l{g}", None, i % 5) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    assert found(spark, monkeypatch, df) == sorted(plain(rows), key=repr)


def test_many_groups_and_equal_rows(spark, monkeypatch):
    rows = [(i % 3, "same", f"g{i % 1500}", "s", 1) for i in range(3000)] + [(None, "hot", "g7", "s", 1)] * 2000
    assert found(spark, monkeypatch, spark.createDataFrame(rows, DOCS)) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("step", [1, 3])
def test_levels_in_small_steps(spark, monkeypatch, step):
    monkeypatch.setattr(merkle, "STEP", step)
    rows = [(i, f"t{i}", "en" if i % 4 else None, "s", i) for i in range(333)]
    assert found(spark, monkeypatch, spark.createDataFrame(rows, DOCS)) == sorted(plain(rows), key=repr)


def test_cuts_cover_a_range():
    for n in (1, 5, 1024, 3000):
        for start, end in ((0, n), (n // 3, n), (n // 3, 2 * n // 3)):
            cuts = list(merkle._cut(start, end, n))
            assert [x for _, _, a, z in cuts for x in range(a, z)] == list(range(start, end))
            assert len(cuts) <= 2 * merkle.STEP + n // 2**merkle.STEP + 1


def test_proofs_hold_the_siblings(spark):
    got = merkle.manifest(spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(9)], DOCS)).orderBy("doc_id").collect()
    levels = tree([r["leaf"] for r in got])
    assert all(r["root"] == r["subroot"] == levels[-1][0] for r in got)
    assert [[s[1:] or None for s in r["proof"]] for r in got] == [[s for s, _ in siblings(levels, i)] for i in range(9)]
