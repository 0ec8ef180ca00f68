"""Registered queries and the pipeline over whole tables: against SQL, brute force, round trips and held-out labels."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyforge.llm import chat, decontaminate, near_dedup, queries, tokens
from tallyforge.llm.common import stored

from .helpers import DOCS, WORD, chat_turns, corpus, held_out, messy, near, quality, repeats
from .test_operators import bm25, decontaminate_words

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
TABLES = ("documents", "labels", "benchmark", "conversations", "embeddings")


@pytest.fixture(scope="module")
def documents():
    return sorted((r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist())


@pytest.fixture(scope="module")
def scores(spark):
    return {r["doc_id"]: r for r in queries.op1_quality(spark, LARGER).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.sql(queries.ORACLE_SQL[name])
    assert cols == sorted(found.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(found.select(*cols).fetchall(), key=repr)


def test_quality_on_held_out_labels(scores):
    labels = pq.read_table(f"{LARGER}/labels.parquet").to_pylist()
    held = [(scores[r["doc_id"]], r["quality"]) for r in labels if r["quality"] is not None and r["doc_id"] in scores and scores[r["doc_id"]]["held_out"]]
    good, bad = [s["score"] for s, q in held if q], [s["score"] for s, q in held if not q]
    assert len(good) > 10 and len(bad) > 10
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([s["predicted"] == q for s, q in held]) > 0.9


def test_quality_query_equals_brute_force(spark, documents):
    labels = [(r["doc_id"], r["quality"]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()]
    want = dict(quality([(i, t) for i, t, _ in documents], labels))
    got = queries.op1_quality(spark, SF).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, abs=1e-7)
    assert all(r["held_out"] == held_out(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.3) for r in got) and len(got) == len(documents)


def test_chat_query_equals_brute_force(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    assert len({r[:2] for r in rows}) == len(rows) and {r[2] for r in rows} <= set(chat.ROLES)
    got = queries.op3_chat_turns(spark, SF).collect()
    assert sorted((r["conv_id"], r["turn_no"], r["role"], r["text"]) for r in got) == sorted(chat_turns(rows, list(chat.ROLES)))
    assert all(r["held_out"] == held_out(r["conv_id"]) and r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>\n" for r in got)


def test_every_whole_benchmark_item_is_found(spark):
    documents = pq.read_table(f"{LARGER}/documents.parquet").to_pylist()
    items = pq.read_table(f"{LARGER}/benchmark.parquet").to_pylist()
    plain = lambda t: f" {' '.join(decontaminate_words(t))} "
    texts = {r["doc_id"]: plain(r["text"]) for r in documents}
    want = {(i, b["item_id"]) for b in items if plain(b["text"]).strip() for i, t in texts.items() if plain(b["text"]) in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontaminate(spark, LARGER).collect()}
    assert want <= got and want


def test_tokens_equal_the_library(spark, documents):
    bpe, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t, _ in documents:
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op6_token_ids(spark, SF).collect())) == want


def test_suffix_query_equals_brute_force(spark, documents):
    want = [(i, n, m, k, hashlib.sha256(rest).hexdigest()) for (i, *_), (n, m, k, rest) in zip(documents, repeats([t for _, t, _ in documents], 200), strict=True)]
    assert sorted(map(tuple, queries.op9_suffix_dedup(spark, SF).collect())) == want


def test_near_query_equals_brute_force(spark, documents):
    want = near([(i, t) for i, t, _ in documents], 3, 85)
    assert sorted(map(tuple, queries.op10_near_dedup(spark, SF).collect())) == sorted((i, n, c, i == c) for i, (n, c) in want.items())


def leaking(text, items, threshold=decontaminate.THRESHOLD, overlap=decontaminate.OVERLAP):
    """Whether every check of some item passes: all passages scored against all items, word runs near them as tuples."""
    words, n = decontaminate_words(text), decontaminate.STRIDE
    found = defaultdict(set)
    for p, a in enumerate(range(-n, len(words), n)):
        for i, s in bm25(items, set(words[max(a, 0) : a + 2 * n])).items():
            if s >= threshold - 1e-9:
                found[i].update(range(max(0, (p - 2) * n), min(len(words), (p + 2) * n)))

    def share(part, near):
        own = decontaminate_words(part)
        k = min(len(own), decontaminate.RUN)
        runs = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
        there = {tuple(words[j : j + k]) for j in near if near.issuperset(range(j, j + k))}
        return len(runs & there) / len(runs) if k else 1.0

    for i, t in items:
        if i in found:
            asked = min(share(part, found[i]) for part in decontaminate.question_and_answer(t))
            if max(asked, 0.0 if decontaminate.asks(t) else share(t, found[i])) >= overlap:
                return True
    return False


def copies(rows):
    """{doc_id: copies} of systematic sampling over (doc_id, text, source): largest first within each source."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    order = [*sorted(s for s in total if s is not None), *([None] if None in total else [])]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(total.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]} or free
        full = any(level * weight[s] > 2 * total[s] for s in over)
        for s in over:
            target[s] = 2 * total[s] if full else level * weight[s]
            left -= target[s]
        free -= over
    out = {}
    for s in order:
        u = int(hashlib.md5(("mix:null" if s is None else f"mix:s:{s}").encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / total[s] if total[s] else 0.0
        for k, i in enumerate(sorted((i for i, _, x in rows if x == s), key=lambda i: (-size[i], i))):
            out[i] = math.floor((k + 1) * rate + u) - math.floor(k * rate + u)
    return out


def test_pipeline_equals_brute_force(spark, documents):
    kept = {r["doc_id"] for r in queries.op1_quality(spark, SF).collect() if r["predicted"]}
    rows = [r for r in documents if r[0] in kept]
    leads = {i for i, (_, c) in near([(i, t) for i, t, _ in rows], 5, 80).items() if i == c}
    rows = [r for r in rows if r[0] in leads]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist() if decontaminate_words(r["text"])]
    rows = [r for r in rows if not leaking(r[1], items)]
    assert 0 < len(rows) < len(leads) < len(kept) < len(documents)
    often, bpe = copies(rows), Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want, start = [], 0
    for i, t, _ in rows:
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, corpus_pipeline.END_ID]
        for _ in range(often[i]):
            want.append((i, start, len(ids), ids))
            start += len(ids)
    assert [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()] == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mixing", "token_ids"]


def test_pipeline_on_messy_and_no_rows(spark, documents, tmp_path):
    """Nulls in every column, repeated rows, blank and long texts, clashing columns: each stage keeps rows of its input as they are."""
    odd = [(None, "nobody's own words stand here", None, None, None)] * 2 + [(9000, None, None, None, None), (9001, " \n", "en", None, 0), (9002, "", None, "a", 0)]
    rows = [(i, t, "en", s, None) for i, t, s in documents] + [(9100 + i, *x[1:]) for i, x in enumerate(corpus(12, 30))] + [(9200, "long " * 30_000, "en", "a", 0)] + odd
    rows += rows[:3] + [(rows[0][0], "another text of one id", "en", None, 0)]
    marks = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    marks = marks.union(spark.createDataFrame([(None, 1, 0), (9000, None, None), (123456789, 0, 1)], marks.schema))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    items = items.union(spark.createDataFrame([(None, None), (7777, " ")], items.schema))
    for name, some in (("messy", rows), ("none", [])):
        at = str(tmp_path / name)
        messy(spark, some).withColumn("kept", F.lit(None).cast("string")).write.parquet(f"{at}/documents.parquet")
        marks.write.parquet(f"{at}/labels.parquet")
        items.write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        columns, ids = docs.columns, {(r["doc_id"], r["text"]) for r in docs.collect()}
        for stage, apply in corpus_pipeline.STAGES[:-1]:
            docs = stored(apply(spark, docs, at), f"messy-{stage}")
            assert docs.columns == columns
            left = Counter((r["doc_id"], r["text"]) for r in docs.collect())
            assert left.keys() <= ids
            ids = set(left)
            if stage == "near_dedup":
                assert len({i for i, _ in left if i is not None}) == sum(n for (i, _), n in left.items() if i is not None)
        coded = corpus_pipeline.token_files(spark, docs, at).orderBy("start").collect()
        bpe = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
        want = Counter((i, *bpe.encode(t or "", add_special_tokens=False).ids, corpus_pipeline.END_ID) for (i, t), n in left.items() for _ in range(n))
        assert Counter((r["doc_id"], *r["token_ids"]) for r in coded) == want and bool(want) == bool(some)
        assert [r["start"] for r in coded] == [sum(r["n_tokens"] for r in coded[:k]) for k in range(len(coded))]


def test_pipeline_workers_hold_little(spark, monkeypatch):
    """Slices and memo of the stages that fill executors: small ones are asked for, and kept to."""
    asked = {}
    monkeypatch.setattr(corpus_pipeline, "write_tokens", lambda *a, **options: asked.update(options))
    monkeypatch.setattr(corpus_pipeline, "read_tokens", lambda *a: None)
    corpus_pipeline.token_files(spark, None, "")
    assert asked["chunk"] <= 512 << 10 and asked["memo"] <= 50_000

    small = tokens.WordTokens(public_tokenizers.path("word_bpe_49k.json"), memo=100)
    words = pa.array([f"word{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnopqrst"])
    ids, _ = small.batch(words, None)
    assert len(small.memo) + len(small.older) <= 100
    assert ids.tolist() == tokens.WordTokens(public_tokenizers.path("word_bpe_49k.json")).batch(words, None)[0].tolist()

    texts = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["one two three " * 4_000] * 40)], ["id", "text"])
    assert max(b.column(1).nbytes for b in near_dedup._sliced([texts])) <= 257 << 10
