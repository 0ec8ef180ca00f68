"""Operators against brute-force versions, and on nulls, blanks, repeats, ties, empty tables and clashing columns."""

import hashlib
import itertools
import random
import time
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import chat, common, components, decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, rollups, suffix_dedup, texthash, tokens

from .helpers import DOCS, corpus, exact, lines_left, messy, near, prose, repeats

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 quality


@pytest.fixture(scope="module")
def marked(spark):
    r = random.Random(5)
    rows, marks = [], []
    for i in range(400):
        good = r.random() < 0.8
        t = prose(r, r.randint(20, 120))
        rows.append((i, t.capitalize() + "." if good else " ".join(w + "%%%" for w in t.split()), "en", "a", 0))
        marks.append((i, int(good), 0))
    rows += [(1000, None, None, None, 0), (1001, "", "en", "a", 0), (None, "Good words here.", "en", "a", 0), (1002, prose(r, 20000), "en", "a", 0)]
    marks += [(0, None, 0), (99999, 1, 0), (None, 0, 0)]
    return rows, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark, marked):
    rows, labels = marked
    got = quality.quality_scores(messy(spark, rows), labels)
    out = {r["doc_id"]: r for r in got.collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    held = {i for i, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in out.items() if r["held_out"]} == held
    truth = dict(labels.filter("doc_id < 400 and quality is not null").select("doc_id", "quality").collect())
    hits = [out[i]["predicted"] == q for i, q in truth.items() if i in held]
    assert len(hits) > 40 and np.mean(hits) > 0.97
    left = quality.without_rejected(messy(spark, rows), labels)
    assert {r["doc_id"] for r in left.collect()} == {i for i, r in out.items() if r["predicted"]}
    assert left.columns == messy(spark, rows).columns


def test_quality_learns_nothing_from_the_held_out_fold(spark, marked):
    rows, labels = marked
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = dict(quality.quality_scores(spark.createDataFrame(rows, DOCS), labels).select("doc_id", "score").collect())
    b = dict(quality.quality_scores(spark.createDataFrame(rows, DOCS), flipped).select("doc_id", "score").collect())
    assert a == b


def test_quality_without_a_class_or_rows(spark, marked):
    rows, labels = marked
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["score"] for r in quality.quality_scores(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty(spark), labels).count() == 0


def test_factors_give_log_densities():
    r = np.random.default_rng(1)
    x, d = r.normal(size=(50, 3)), 3
    cov = [np.cov(r.normal(size=(d, 40))) + np.eye(d) * 0.1 for _ in range(2)]
    means = r.normal(size=(2, d))
    low = [np.linalg.cholesky(c) for c in cov]
    m = quality.Model(means, np.array([np.linalg.inv(a) for a in low]), np.array([2 * np.log(np.diag(a)).sum() for a in low]), 0.3)
    dens = [-0.5 * np.einsum("ij,jk,ik->i", x - means[c], np.linalg.inv(cov[c]), x - means[c]) - 0.5 * np.log(np.linalg.det(cov[c])) for c in (0, 1)]
    assert m.score(x) == pytest.approx(1 / (1 + np.exp(-(dens[1] - dens[0] + 0.3))))


# 2 rollups


def test_rollup_signs_and_replays(spark, tmp_path):
    store = str(tmp_path / "store")
    cols = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    first = spark.createDataFrame([("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, None, "t1", 7, 0), ("insert", "a", "en", "t2", None, None)], cols)
    second = spark.createDataFrame([("delete", "a", "en", "t1", 5, None), ("revise", "a", "en", "t1", 4, 10), (None, "a", "en", "t1", 99, 0), ("other", "a", "en", "t1", 99, 0), ("delete", None, None, "t1", 7, None)], cols)
    assert rollups.totals(spark, store).count() == 0
    assert rollups.commit_batch(spark, store, "b1", first)
    assert not rollups.commit_batch(spark, store, "b1", first)
    assert {tuple(r) for r in rollups.totals(spark, store).collect()} == {("a", "en", "t1", 2, 15), (None, None, "t1", 1, 7), ("a", "en", "t2", 1, 0)}
    assert rollups.commit_batch(spark, store, "b2", second)
    assert not rollups.commit_batch(spark, store, "b2", second.limit(1))
    assert {tuple(r) for r in rollups.totals(spark, store).collect()} == {("a", "en", "t1", 1, 4), ("a", "en", "t2", 1, 0)}
    assert rollups.commit_batch(spark, store, "b3", first.limit(0))
    with pytest.raises(ValueError):
        rollups.commit_batch(spark, store, "a/b", first)


def test_rollup_of_messy_documents(spark):
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (1, 0, 1), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(0, "a *** b", "en", "s", 0), (1, "c d", "en", "s", 0), (2, None, "en", None, 0), (None, "e", None, "s", 0), (2, "f f", "en", "s", 0)]
    got = {tuple(r) for r in rollups.rollup_of_documents(messy(spark, rows), labels).collect()}
    assert got == {("s", "en", "words-1", 2, 4), ("s", "en", "letters-2", 2, 4), (None, "en", "words-1", 1, 0), (None, "en", "letters-2", 1, 0), ("s", None, "words-1", 1, 1), ("s", None, "letters-2", 1, 1)}
    assert rollups.rollup_of_documents(empty(spark), labels).count() == 0


def test_one_of_two_writers_commits(spark, tmp_path):
    store, cols = str(tmp_path / "store"), "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    rows = spark.createDataFrame([("insert", "a", "en", "t", 3, None)], cols)
    with ThreadPoolExecutor(4) as pool:
        for batch in ("b1", "b2"):
            assert sorted(pool.map(lambda _: rollups.commit_batch(spark, store, batch, rows), range(4))) == [False, False, False, True]  # noqa: B023
    assert [tuple(r) for r in rollups.totals(spark, store).collect()] == [("a", "en", "t", 2, 6)]
    assert not rollups._claim(spark, f"{store}/commits/b1", "other") and rollups._text(spark, f"{store}/commits/b1") != "other"
    assert rollups.compact(spark, store) and not rollups.compact(spark, store)
    assert not rollups.commit_batch(spark, store, "b2", rows) and rollups.commit_batch(spark, store, "b3", rows)
    assert [tuple(r) for r in rollups.totals(spark, store).collect()] == [("a", "en", "t", 3, 9)]
    assert rollups.compact(spark, store)
    assert [tuple(r) for r in rollups.totals(spark, store).collect()] == [("a", "en", "t", 3, 9)]


def test_markers_have_one_writer_and_are_whole(spark, tmp_path):
    with ThreadPoolExecutor(4) as pool:
        for batch in range(300):
            path = f"{tmp_path}/store/commits/{batch}"
            won = list(pool.map(lambda w: rollups._claim(spark, path, f"writer-{w}"), range(4)))  # noqa: B023
            assert won.count(True) == 1 and rollups._text(spark, path) == f"writer-{won.index(True)}"
    assert rollups._names(spark, f"{tmp_path}/store/commits") == sorted(map(str, range(300)))


def test_rollup_with_library_tokenizers(spark):
    paths = {n: public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k")}
    rows = [*corpus(3, 30), (900, "x*** " * 40000, "en", "a", 0)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i, *_ in rows]
    got = {tuple(r) for r in rollups.rollup_of_documents(messy(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {n: rollups.Library(p) for n, p in paths.items()}).collect()}
    want = Counter()
    for (_, t, lang, source, _), (_, good, toxic) in zip(rows, labels, strict=True):
        text = t or "" if good else regex.sub(r"[^\p{L}\p{N}\x20\x09-\x0D]+", " ", t or "")
        for n, p in () if toxic else paths.items():
            want[source, lang, n, "docs"] += 1
            want[source, lang, n, "tokens"] += len(Tokenizer.from_file(p).encode(text, add_special_tokens=False).ids)
    assert got == {(s, la, n, c, want[s, la, n, "tokens"]) for (s, la, n, k), c in want.items() if k == "docs"}


# 3 chat


def talk(n=120):
    r = random.Random(2)
    rows = []
    for c in range(n):
        turn = 0
        if c % 4 == 0:
            rows.append((c, turn, "system", prose(r, 12).capitalize() + "."))
            turn += 1
        for k in range(r.randint(1, 6)):
            text = "\n".join(prose(r, r.randint(3, 25)).capitalize() + "." for _ in range(r.randint(1, 4)))
            rows.append((c, turn, ("user", "assistant")[k % 2], text))
            turn += 1
    return rows


def test_chat_roles_held_out(spark):
    rows = talk()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn_no"]): r for r in chat.chat_turns(df.withColumn("line", F.lit(1)).withColumn("state", F.lit(2))).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = [(c, t) in got and got[c, t]["role"] == role and got[c, t]["text"] == text for c, t, role, text in held]
    assert len(right) > 30 and np.mean(right) > 0.95
    some = got[held[0][0], 0]
    assert some["rendered"] == f"<|{some['role']}|>\n{some['text']}\n<|end|>\n"


def test_chat_blocks_equal_one_run(spark):
    r = np.random.default_rng(0)
    n = chat.STATES
    m = chat.Hmm(np.log(r.dirichlet(np.ones(n))), np.log(r.dirichlet(np.ones(n), n)), np.log(r.dirichlet(np.ones(96), n)).T)
    codes = r.integers(0, 96, 5001)
    want = m.decode(codes, m.start)
    lines = spark.createDataFrame([(1, i, int(c)) for i, c in enumerate(codes)], "conv long, number long, code int")
    got = chat.recovered_lines(lines, m).orderBy("number").collect()
    assert chat.BLOCK * 2 < len(codes) and [x["state"] for x in got] == want.tolist()
    opens = chat.opening(want, -1)
    assert [x["opens"] for x in got] == opens.tolist() and [x["turn_no"] for x in got] == (np.cumsum(opens) - 1).tolist()


def test_viterbi_equals_trying_every_path():
    r = np.random.default_rng(1)
    n = chat.STATES
    for size in (1, 2, 5):
        m = chat.Hmm(np.log(r.dirichlet(np.ones(n))), np.log(r.dirichlet(np.ones(n), n)), np.log(r.dirichlet(np.ones(96), n)).T)
        codes = r.integers(0, 96, size)

        def chance(path):
            return m.start[path[0]] + sum(m.step[a, b] for a, b in itertools.pairwise(path)) + sum(m.show[c, s] for c, s in zip(codes, path, strict=True))  # noqa: B023

        assert tuple(m.decode(codes, m.start)) == max(itertools.product(range(n), repeat=size), key=chance)


def test_lines_of_one_long_conversation_are_numbered_over_ranges(spark):
    r = random.Random(7)
    rows = [(1, k, ("user", "assistant")[k % 2], "\n".join("x" * r.randint(0, 9) for _ in range(r.randint(1, 5)))) for k in range(3000)] + [(None, 0, "user", "a"), (None, 1, "user", "b\nc"), (0, 0, "user", "z")]
    r.shuffle(rows)
    got = chat.transcript_lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv in (None, 0, 1):
        own = sorted((x for x in got if x["conv"] == conv), key=lambda x: x["number"])
        assert [x["number"] for x in own] == list(range(len(own)))
        assert [(x["turn"], x["at"]) for x in own] == sorted((x["turn"], x["at"]) for x in own)
        assert sorted({x["turn"] for x in own}) == list(range(sum(c == conv for c, *_ in rows)))


def test_chat_on_messy_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert chat.chat_turns(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, None, "user", "Hi."), (1, 2, None, None), (None, 0, "user", "X."), (None, 0, "user", "X."), (2, 0, "tool", ""), (3, 1, "assistant", "a" * 100000)]
    got = chat.chat_turns(spark.createDataFrame(rows + talk(30), kind)).collect()
    assert {r["conv_id"] for r in got} == {None, 1, 2, 3, *range(30)}
    assert all(r["role"] in chat.ROLES for r in got)


# 4 decontamination


def bm25(items, passage):
    """Scores of a set of passage words against all items, each over the item's own score."""
    from collections import Counter
    from math import log

    docs = {i: decontaminate_words(t) for i, t in items}
    df = Counter(w for d in docs.values() for w in set(d))
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, d in docs.items():
        c = Counter(d)
        w = {t: log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * n * (decontaminate.K1 + 1) / (n + decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(d) / mean)) for t, n in c.items()}
        out[i] = sum(v for t, v in w.items() if t in passage) / sum(w.values())
    return out


def decontaminate_words(t):
    return "".join(" " if c.isascii() and not c.isalnum() else c.lower() if c.isascii() else c for c in t or "").split()


def test_retrieval_equals_scoring_everything(spark):
    r = random.Random(8)
    vocabulary = [prose(r, 1) for _ in range(150)] + ["the"] * 40 + ["of"] * 30
    draw = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, draw(r.randint(3, 40)) + ".") for i in range(60)]
    texts = [draw(r.randint(0, 400)) for _ in range(40)] + [draw(30) + " " + items[k][1].upper() + " " + draw(90) for k in range(20)] + ["", None]
    df = spark.createDataFrame(items, "item_id long, text string")
    for most in (1000, 17):
        found = {}
        for index in decontaminate.indexes(df, threshold=0.3, most=most):
            words, ends = decontaminate.terms(pa.array(texts, pa.string()))
            for t, _, i, s in zip(*decontaminate.retrieve(index, words, ends, 0.3), strict=True):
                found[int(t), int(index.items[i])] = max(s, found.get((int(t), int(index.items[i])), 0))
        want = {}
        for t, text in enumerate(texts):
            own, n = decontaminate_words(text), decontaminate.STRIDE
            for a in range(-n, len(own), n):
                for i, s in bm25(items, set(own[max(a, 0) : a + 2 * n])).items():
                    if s >= 0.3 - 1e-9:
                        want[t, i] = max(s, want.get((t, i), 0))
        assert found.keys() == want.keys() and len(want) > 20
        assert all(found[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("n", [200, 1000, 5000])
def test_items_in_the_words_of_the_corpus_cost_little(spark, monkeypatch, n):
    """Items cut from other texts over one vocabulary: few entries are scored, and few seconds are spent."""
    r = np.random.default_rng(n)
    vocabulary = np.array([prose(random.Random(k), 1) + str(k) for k in range(8000)])
    often = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda size: " ".join(vocabulary[r.choice(len(vocabulary), size, p=often / often.sum())])
    items = [(i, draw(40) + ".") for i in range(n)]
    texts = [draw(3000) for _ in range(30)] + [draw(500) + " " + items[k][1] + " " + draw(500) for k in range(10)]
    (index,) = decontaminate.indexes(spark.createDataFrame(items, "item_id long, text string"))
    scored = []
    plain = decontaminate.candidates
    monkeypatch.setattr(decontaminate, "candidates", lambda *a: scored.append(plain(*a)) or scored[-1])
    words, ends = decontaminate.terms(pa.array(texts, pa.string()))
    began = time.process_time()
    t, _, e, s = decontaminate.retrieve(index, words, ends, 0.5)
    seconds = time.process_time() - began
    assert {(30 + k, k) for k in range(10)} <= set(zip(t.tolist(), e.tolist(), strict=True))
    pairs = sum(len(p) for p, _ in scored)
    assert pairs < 0.001 * n * len(words) / decontaminate.STRIDE
    assert seconds / (sum(map(len, texts)) / 1e9) < 400


def test_leaks_are_found_and_clean_texts_left(spark):
    r = random.Random(3)
    items = [(i, f"What is {prose(r, 12)}? {prose(r, 5).capitalize()}.") for i in range(20)] + [(50, None), (51, ""), (None, prose(r, 20)), (3, "again " + prose(r, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    first = dict((i, t) for i, t in items[:20] if i != 3)
    rows = [(k, f"{prose(r, 70)} {first[k]} {prose(r, 40)}", "en", "a", 0) for k in (0, 1, 2, 4)] + [(k, prose(r, 200), "en", "a", 0) for k in range(10, 20)]
    rows += [(100, first[5].split("?")[0] + "? " + prose(r, 30), "en", "a", 0), (101, None, None, None, 0), (102, " ", "en", "a", 0), (103, prose(r, 20000) + " " + first[6] + prose(r, 300), "en", "a", 0), (None, first[7], "en", "a", 0), (0, rows[0][1], "en", "a", 0)]
    got = sorted(((x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(messy(spark, rows), bench).collect()), key=str)
    assert got == sorted([(0, 0), (0, 0), (1, 1), (2, 2), (4, 4), (103, 6), (None, 7)], key=str)
    left = decontaminate.without_leaks(messy(spark, rows), bench)
    assert {x["doc_id"] for x in left.collect()} == {*range(10, 20), 100, 101, 102} and left.columns == messy(spark, rows).columns
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(messy(spark, rows), bench.limit(0)).count() == 0


def test_long_items_are_found_at_every_offset(spark):
    r = random.Random(17)
    items = [(i, f"{prose(r, n - 9)}? {prose(r, 9)}.") for i, n in enumerate((64, 65, 128, 200, 300, 300, 1000, 1000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(100 * i + k, f"{prose(r, 40 + 17 * k)} {t} {prose(r, 150)}", "en", "a", 0) for i, t in items for k in range(8)]
    clean = [(9000 + k, prose(r, 1500), "en", "a", 0) for k in range(5)] + [(9100, " ".join(items[6][1].split()[:300]) + prose(r, 300), "en", "a", 0)]
    for most in (20_000, 10):
        got = decontaminate.contaminated(messy(spark, rows + clean), bench, most=most).collect()
        assert sorted((x["doc_id"], x["item_id"]) for x in got) == [(100 * i + k, i) for i, _ in items for k in range(8)]
        assert all(x["score"] == pytest.approx(1) and x["question_overlap"] == x["answer_overlap"] == 1 for x in got)


def test_an_answer_far_from_its_question_is_no_leak(spark):
    r = random.Random(41)
    asked = f"{prose(r, 30)}? yes."
    question, answer = asked.split("? ")
    bench = spark.createDataFrame([(1, asked)], "item_id long, text string")
    rows = [(k, f"{prose(r, 100)} {question} {prose(r, gap)} {answer} {prose(r, 100)}", "en", "a", 0) for k, gap in enumerate((1, 20, 400, 5000))]
    assert sorted(x["doc_id"] for x in decontaminate.contaminated(messy(spark, rows), bench).collect()) == [0, 1]


def test_a_benchmark_of_many_indexes_is_searched_in_waves(spark):
    r = random.Random(43)
    items = [(i, f"{prose(r, 15)}? {prose(r, 4)}.") for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"{prose(r, 50)} {t} {prose(r, 50)}", "en", "a", 0) for i, t in items] + [(99, prose(r, 100), "en", "a", 0)]
    assert len(list(decontaminate.indexes(bench, most=2))) > decontaminate.WAVE
    assert sorted((x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(messy(spark, rows), bench, most=2).collect()) == [(i, i) for i in range(12)]
    assert [x["doc_id"] for x in decontaminate.without_leaks(messy(spark, rows), bench, most=2).collect()] == [99]
    alive, most = 0, 0
    for _, wave, last in decontaminate._waves(messy(spark, rows), bench, 0.5, 0.6, 2):
        alive += len(wave)
        most = max(most, alive)
        if not last:
            for index in wave:
                index.destroy()
            alive -= len(wave)
    assert most == decontaminate.WAVE


def test_every_text_of_a_benchmark_id_counts(spark):
    r = random.Random(23)
    items = [(1, prose(r, 20) + "."), (1, prose(r, 20) + "."), (None, prose(r, 20) + "."), (None, prose(r, 20) + "."), (2, prose(r, 20) + ".")]
    bench = spark.createDataFrame([*items, items[0], items[2], (None, None), (None, " ")], "item_id long, text string")
    rows = [(k, f"{prose(r, 50)} {t} {prose(r, 50)}", "en", "a", 0) for k, (_, t) in enumerate(items)] + [(9, prose(r, 100), "en", "a", 0)]
    for most in (20_000, 2):
        got = decontaminate.contaminated(messy(spark, rows), bench, most=most).collect()
        assert sorted((x["doc_id"], x["item_id"]) for x in got) == [(k, i) for k, (i, _) in enumerate(items)]
    assert [x["doc_id"] for x in decontaminate.without_leaks(messy(spark, rows), bench).collect()] == [9]


def test_a_statement_without_its_last_sentence_is_a_leak(spark):
    r = random.Random(29)
    told, asked = f"{prose(r, 30)}. {prose(r, 8)}.", f"{prose(r, 30)}? {prose(r, 8)}."
    bench = spark.createDataFrame([(1, told), (2, asked), (3, prose(r, 40) + "?")], "item_id long, text string")
    cut = lambda t, k: " ".join(t.split()[:k])
    rows = [(k, f"{prose(r, 50)} {t} {prose(r, 50)}", "en", "a", 0) for k, t in enumerate((told, cut(told, 30), cut(told, 15), asked, cut(asked, 30)))]
    got = decontaminate.contaminated(messy(spark, rows), bench).collect()
    assert sorted((x["doc_id"], x["item_id"]) for x in got) == [(0, 1), (1, 1), (3, 2)]


# 5 mixing


def test_mix_meets_targets(spark):
    r = random.Random(4)
    rows = [(i, prose(r, r.choice((3, 20, 60))), "en", ("a", "b", "c", "d", None)[min(4, int(r.random() ** 2 * 6))], 0) for i in range(500)] + [(900, None, None, "a", 0), (901, "", None, "empty", 0)]
    got = mixing.mix(messy(spark, rows)).collect()
    assert sorted(g["doc_id"] for g in got) == sorted(x[0] for x in rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(messy(spark, rows).repartition(7)).collect()), key=str)
    sizes, targets, taken = {}, {}, {}
    for g in got:
        assert g["taken"] <= 2 * g["size"]
        sizes[g["source"]], targets[g["source"]] = g["source_size"], g["target"]
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    for s in order:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - targets[s]) <= 61
    out = mixing.mixed_rows(messy(spark, rows))
    assert out.columns == messy(spark, rows).columns
    copies = {g["doc_id"]: g["copies"] for g in got if g["copies"]}
    assert {x["doc_id"]: x["count"] for x in out.groupBy("doc_id").count().collect()} == copies


def test_mix_of_texts_of_one_id_agrees_in_every_run(spark):
    rows = [(i // 4, f"w{i} " * 7, "en", "ab"[i % 2], 0) for i in range(400)] + [(None, "same " * 7, "en", "a", 0)] * 300
    runs = [sorted(map(tuple, mixing.mix(spark.createDataFrame(rows[k:] + rows[:k], DOCS).repartition(n)).collect()), key=repr) for k, n in ((0, 3), (137, 5))]
    assert runs[0] == runs[1]
    seen = {}
    plain = mixing.stored
    mixing.stored = lambda df, label: seen.setdefault(label, plain(df, label))
    try:
        mixing.mix(spark.createDataFrame([(None, "same " * 7, "en", "a", 0)] * 4000, DOCS)).collect()
    finally:
        mixing.stored = plain
    assert max(r["count"] for r in seen["mix-rows"].groupBy("part").count().collect()) < 2000


def test_mix_on_repeated_and_no_rows(spark):
    rows = [(1, "a b c", "en", "s", 0)] * 3 + [(None, "d e", "en", None, 0)] * 2
    got = mixing.mix(messy(spark, rows)).collect()
    assert len(got) == 5
    assert mixing.mixed_rows(messy(spark, rows)).count() == sum(g["copies"] for g in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_rows(empty(spark)).count() == 0


# 6 tokens


def test_token_files_round_trip(spark, tmp_path):
    r = random.Random(6)
    odd = ["It's we're I'M <|endoftext|> x<|startoftext|>y", "ÀÉ ß Ÿ ñ, é́ é İ Σίσυφος ΣΑΣ", "a1b2 3.14 $5,000.00 #tag @me", "日本語 text　wide space", "!!! ... (a) [b] {c} a-b_c~d`e^f", "\x00\x01 \x7f", "🙂 👩‍👩‍👧"]
    rows = corpus(6, 40) + [(500 + i, t, None, None, 0) for i, t in enumerate(odd)] + [(None, "none", None, None, 0), (3, "repeated id", None, None, 0)]
    path = str(tmp_path / "files")
    got = sorted((tuple(x) for x in tokens.tokens_round_trip(messy(spark, rows), WORD_BPE, 1, path, shards=3).collect()), key=lambda x: x[1])
    bpe, want, start = Tokenizer.from_file(WORD_BPE), [], 0
    known = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    assert [g[0] for g in got] == [x[0] for x in known]
    for i, t, *_ in known:
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted(((g[0], g[2], g[3]) for g in got), key=str) == sorted(want, key=str)
    for g in got:
        assert g[1] == start
        start += g[2]
    index = {(x["doc_id"], x["start"]): x["n_tokens"] for x in tokens.token_index(spark, path).collect()}
    assert index == {(g[0], g[1]): g[2] for g in got}
    some = tokens.read_tokens(spark, path, 10, 12).collect()
    assert {x["doc_id"] for x in some} == {10, 11, 12} and all(len(x["token_ids"]) == x["n_tokens"] for x in some)
    file = next(p for p in sorted((tmp_path / "files").glob("*.parquet")) if pq.ParquetFile(p).metadata.num_rows)
    meta = pq.ParquetFile(file).metadata.row_group(0)
    columns = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    assert all(c.has_offset_index for c in columns.values())
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "RLE_DICTIONARY" in columns["token_ids.list.element"].encodings


def test_no_tokens_from_no_rows(spark):
    assert tokens.tokens_round_trip(empty(spark), WORD_BPE, 1).count() == 0


# 7 exact


def test_exact_groups(spark):
    rows = corpus(7, 80)
    rows += [(i, "Same  text\n", "en", "a", 0) for i in range(200, 330)] + [(205, "same TEXT", "en", "a", 0), (None, "lonely null", None, None, 0), (None, "lonely null", None, None, 0), (7, rows[7][1], "en", "a", 0), (None, "Same text ", "en", "a", 0)]
    for ranges in (1, 64):
        got = [tuple(x) for x in exact_dedup.exact_groups(messy(spark, rows), ranges=ranges).collect()]
        assert len(got) == len(rows)
        want = exact([(i, t) for i, t, *_ in rows])
        strip = lambda v: sorted((x[:3] + x[4:] for x in v), key=str)
        assert strip(got) == strip(want)
        kept = {}
        for _, _, _, k, sha in got:
            kept[sha] = kept.get(sha, 0) + k
        assert set(kept.values()) == {1}
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


# 8 lines


def test_line_dedup(spark):
    rows = corpus(8, 80) + [(300, "a\nb\nc\nd", "en", "a", 0), (301, "x\na\nb\nc\nd\ny", "en", "a", 0), (302, "\n\n\n\n", "en", "a", 0), (303, "\n\n\n\n", "en", "a", 0), (304, "q\nq\nq\nq\nq", "en", "a", 0)]
    want = lines_left([(i, t) for i, t, *_ in rows])
    got = {x["doc_id"]: (x["clean_text"], x["n_removed"]) for x in line_dedup.line_dedup(messy(spark, rows)).collect()}
    assert got == want and sum(n for _, n in want.values()) > 10
    texts = [(5, "a\nb\nc\nx"), (5, "a\nb\nc\ny"), (6, "a\nb\nc")]
    first = min((t for i, t in texts if i == 5), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    apart = line_dedup.line_dedup(messy(spark, [(i, t, "en", "a", 0) for i, t in texts])).collect()
    assert sorted((x["doc_id"], x["clean_text"]) for x in apart) == sorted((i, t if t == first else t[6:]) for i, t in texts)
    again = line_dedup.line_dedup(messy(spark, [rows[-5]] * 2 + [(None, "a\nb\nc\nd", "en", "a", 0)])).collect()
    assert sorted((str(x["doc_id"]), x["n_removed"]) for x in again) == [("300", 4), ("300", 4), ("None", 0)]
    assert line_dedup.line_dedup(empty(spark)).count() == 0


# 9 suffixes


@pytest.mark.parametrize("length", [64, 200])
def test_repeated_spans(spark, length):
    rows = corpus(9, 70) + [(None, "Q" * 300, None, None, 0), (5, prose(random.Random(1), 60), "en", "a", 0)] + [(700, prose(random.Random(2), 60), "en", "a", 0)] * 2
    got = suffix_dedup.repeated_spans(messy(spark, rows), length=length).collect()
    want = repeats([t for _, t, *_ in rows], length)
    seen = sorted((str(x["doc_id"]), x["n_bytes"], sum(s["end"] - s["start"] for s in x["spans"]), len(x["spans"]), hashlib.sha256(x["kept"]).hexdigest()) for x in got)
    assert seen == sorted((str(i), n, m, k, hashlib.sha256(b).hexdigest()) for (i, *_), (n, m, k, b) in zip(rows, want, strict=True))
    assert sum(m for _, m, _, _ in want) > 1000


def test_repeats_of_every_shape(spark):
    """Texts cut from one string at all offsets: matches on either side of an anchor meet in all ways."""
    r = random.Random(11)
    base = prose(r, 90)
    texts = []
    for _ in range(60):
        a, b = sorted(r.sample(range(len(base)), 2))
        texts.append(prose(r, r.randint(0, 9)) + base[a:b] + prose(r, r.randint(0, 9)))
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    got = {x["doc_id"]: (x["n_bytes"], sum(s["end"] - s["start"] for s in x["spans"]), len(x["spans"]), bytes(x["kept"])) for x in suffix_dedup.repeated_spans(spark.createDataFrame(rows, DOCS), length=80).collect()}
    assert got == dict(enumerate(repeats(texts, 80)))


def test_multikey_order():
    r = np.random.default_rng(3)
    keys = r.integers(0, 3, (400, 21)).astype(np.uint8)
    keys[50:120] = keys[0]
    keys[120:200, :15] = keys[1, :15]
    order = suffix_dedup.multikey_order(keys)
    assert [bytes(k) for k in keys[order]] == sorted(bytes(k) for k in keys)


def joined_rows(df):
    """The rows that came out of each join of a plan that has run."""
    found, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            open_ += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
    return found


@pytest.mark.parametrize("hot", [0, 3000])
def test_counted_joins_pass_each_row_once(spark, tmp_path, hot):
    """With hot keys and without, joins make the rows of the result and no more, so their number grows with the input."""
    rows = [(i % 1000, 1.0, i) for i in range(2000)] + [(5000 + i, 1.0, i) for i in range(4000)] + [(-1, (-0.0, 0.0)[i % 2], i) for i in range(hot)]
    spark.createDataFrame(rows, "k long, x double, v long").write.parquet(f"{tmp_path}/left")
    left = spark.read.parquet(f"{tmp_path}/left")
    left.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).filter("n > 1").write.parquet(f"{tmp_path}/right")
    right = spark.read.parquet(f"{tmp_path}/right")
    got = common.join_counted(left, right, ["k", "x"], "n")
    top = {i: i + 1000 for i in range(1000)} | {-1: hot - 1}
    assert got.columns == ["k", "x", "v", "top"]
    assert Counter(map(tuple, got.collect())) == Counter((k, x, v, top[k]) for k, x, v in rows if k in top)
    assert sum(joined_rows(got)) == 2000 + hot
    with pytest.raises(ValueError):
        common.join_counted(left, right.withColumn("k", F.col("k").cast("int")), ["k", "x"], "n")


def test_repeats_of_nothing(spark):
    assert suffix_dedup.repeated_spans(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(empty(spark), length=300)


# 10 near duplicates


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, shingle, percent):
    rows = corpus(10, 90)
    want = near([(i, t) for i, t, *_ in rows], shingle, percent)
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(messy(spark, rows), shingle=shingle, percent=percent).collect()}
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == want
    assert all(x["kept"] == (i == x["component_id"]) for i, x in got.items())
    left = near_dedup.without_near_duplicates(messy(spark, rows), shingle=shingle, percent=percent)
    assert sorted(x["doc_id"] for x in left.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert left.columns == messy(spark, rows).columns


def test_near_group_with_many_changes(spark):
    """Edited copies of one text, linked or not: the prefix filter loses none."""
    r = random.Random(12)
    base = prose(r, 120).split(" ")
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = r.choice(("one", "two", "three", prose(r, 1)))
        rows.append((i, " ".join(words), "en", "a", 0))
    want = near([(i, t) for i, t, *_ in rows], 3, 85)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=3, percent=85).collect()}
    assert got == want and 1 < len({c for _, c in want.values()}) < 80


@pytest.mark.parametrize("own", [14, 28])
def test_near_family_of_one_template(spark, monkeypatch, own):
    """Pages of one template, their similarity round the threshold: comparisons grow with the pages, not their pairs."""
    r = random.Random(own)
    base, some = prose(r, 300).split(" "), prose(r, 2000).split(" ")
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(own // 3):
            words[r.randrange(len(words))] = r.choice(some)
        rows.append((i, " ".join(words), "en", "a", 0))
    compared = []
    plain = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *a: compared.append(pairs.count()) or plain(pairs, *a))
    want = near([(i, t) for i, t, *_ in rows], 3, 85)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=3, percent=85).collect()}
    assert got == want
    print(compared, len({c for _, c in want.values()}))
    assert sum(compared) < 10 * len(rows)


@pytest.mark.parametrize("pages", [200, 400, 800])
def test_near_pages_of_paragraph_versions(spark, monkeypatch, pages):
    """Pages of 30 paragraphs, each one of three versions, none linked: every shingle is on a third of them, few are compared."""
    r = random.Random(41)
    versions = [[prose(r, 12) for _ in range(3)] for _ in range(30)]
    rows = [(i, " ".join(r.choice(v) for v in versions), "en", "a", 0) for i in range(pages)]
    compared = []
    plain = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *a: compared.append(pairs.count()) or plain(pairs, *a))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=3, percent=85).collect()}
    assert got == {i: i for i in range(pages)}
    print(pages, compared)
    assert sum(compared) < 8 * pages


@pytest.mark.parametrize(("exact", "turns"), [(False, 1), (False, 6), (True, 1)])
def test_near_large_buckets_with_links(spark, monkeypatch, exact, turns):
    """Buckets that no turn closes, linked and not linked pairs in them: cut finer or through the prefix filter, no link is lost."""
    r = random.Random(43)
    monkeypatch.setattr(near_dedup, "FEW", 3)
    monkeypatch.setattr(near_dedup, "PAIRS", 0)
    monkeypatch.setattr(near_dedup, "TURNS", turns)
    base, rows = prose(r, 150).split(" "), []
    for i in range(60):
        words = list(base)
        for _ in range(r.randint(1, 9)):
            words[r.randrange(len(words))] = prose(r, 1)
        rows.append((2 * i, " ".join(words), "en", "a", 0))
        if i % 4 == 0:
            rows.append((2 * i + 1, " ".join(words[:-1]), "en", "a", 0))
    cut = []
    plain = near_dedup._finer
    monkeypatch.setattr(near_dedup, "_finer", lambda *a: cut.append(1) or plain(*a))
    want = near([(i, t) for i, t, *_ in rows], 3, 85)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=3, percent=85, exact=exact).collect()}
    assert got == want and 5 < len({c for _, c in want.values()}) < 60
    assert cut == [1] * (not exact)


@pytest.mark.parametrize("few", [0, 20_000])
def test_near_pairs_few_or_many(spark, monkeypatch, few):
    """Pages of paragraph versions, none linked, and copies of some of them: results agree whether pairs are broadcast or shuffled."""
    r = random.Random(47)
    monkeypatch.setattr(near_dedup, "FEW_PAIRS", few)
    versions = [[prose(r, 12) for _ in range(3)] for _ in range(30)]
    rows = [(2 * i, " ".join(r.choice(v) for v in versions), "en", "a", 0) for i in range(60)]
    rows += [(i + 1, t + " " + prose(r, 1), "en", "a", 0) for i, t, *_ in rows[::9]]
    want = near([(i, t) for i, t, *_ in rows], 3, 85)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=3, percent=85).collect()}
    assert got == want and len({c for _, c in want.values()}) == 60


def test_signature_floor():
    floor = near_dedup.agreement_floor(85)
    assert 100 < floor < 125 and near_dedup.agreement_floor(80) < floor
    assert near_dedup.agreement_floor(100) == 160


def test_near_duplicates_on_messy_rows(spark):
    rows = [(4, "a b c d e f", "en", "a", 0), (4, "a b c d e f", "en", "a", 0), (None, "a b c d e f", "en", "a", 0), (2, "A b C d\ne f", "en", "a", 0), (9, "", "en", "a", 0), (8, None, "en", "a", 0), (7, "x", "en", "a", 0), (6, "X", "en", "a", 0)]
    got = sorted((str(x["doc_id"]), x["n_shingles"], x["component_id"], x["kept"]) for x in near_dedup.near_duplicates(messy(spark, rows)).collect())
    assert got == sorted([("4", 2, 2, False), ("4", 2, 2, False), ("None", 2, None, True), ("2", 2, 2, True), ("9", 0, 9, True), ("8", 0, 8, True), ("7", 1, 6, False), ("6", 1, 6, True)])
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    assert sorted(str(x["doc_id"]) for x in near_dedup.without_near_duplicates(messy(spark, rows)).collect()) == ["2", "6", "8", "9", "None"]


@pytest.mark.parametrize("top", [50, 2**63 - 1])
def test_texts_of_a_repeated_id_keep_their_links(spark, top):
    r = random.Random(31)
    a, b, c, d = (prose(r, 120) for _ in range(4))
    near_to = lambda t: t + " " + prose(r, 1)
    texts = [(1, a), (1, b), (2, near_to(a)), (3, near_to(b)), (4, b), (5, c), (5, near_to(b)), (6, near_to(c)), (7, d), (top, near_to(d)), (top, d)]
    rows = [(i, t, "en", "a", 0) for i, t in texts]
    for part in (rows, rows[::-1]):
        got = {(x["doc_id"], x["component_id"], x["kept"]) for x in near_dedup.near_duplicates(messy(spark, part)).collect()}
        assert got == {(i, 1 if i < 7 else 7, i in (1, 7)) for i, _ in texts}
        left = near_dedup.without_near_duplicates(messy(spark, part))
        assert sorted((x["doc_id"], x["text"]) for x in left.collect()) == [(1, min(a, b)), (7, d)] and left.columns == messy(spark, part).columns


def test_components_of_chains_and_stars(spark):
    r = random.Random(13)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + r.randrange(30), 200 + r.randrange(30)) for _ in range(25)]
    r.shuffle(pairs)
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        if a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    got = dict(components.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {i: top(i) for i in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_do_not_depend_on_chunks(monkeypatch):
    texts = pa.array(["Some words", None, "", "a" * 5000 + " b", "x\ty\nz"])
    one = texthash.texts_words(texts, lower=True)
    monkeypatch.setattr(texthash, "CHUNK", 7)
    two = texthash.texts_words(texts, lower=True)
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist() == [0, 2, 2, 2, 4, 7]
    assert list(texthash.slices(texts, 12)) == [(0, 3), (3, 4), (4, 5)]
