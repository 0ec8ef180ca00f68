"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyforge.llm import queries, spelling

from .helpers import DOCS, lower_ascii, messy

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced character."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n, ratio=5):
    near = {w: sorted((o for o in n if one_edit(w, o)), key=lambda o: (-n[o], o)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= ratio * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def rows_of(df):
    return sorted(tuple(r[c] or "" if c == "form" else r[c] or 0 if c == "form_n" else r[c] for c in COLUMNS) for r in df.collect())


def counted(rows):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            k = h % len(run)
            n[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


@pytest.mark.parametrize("alphabet", ["ab", "abc\u00e9\u00ff", "abcdefghijklmnopqrstuvwxyz"])
def test_groups_equal_all_pairs(spark, alphabet):
    r = random.Random(len(alphabet))
    n = {}
    for _ in range(160):
        word = "".join(r.choice(alphabet) for _ in range(r.randint(6, 9)))
        n[word] = 5 ** r.randint(1, 7) + r.randint(0, 1)
        for _ in range(2):
            k = r.randrange(len(word))
            word = r.choice((word[:k] + word[k + 1 :], word[:k] + r.choice(alphabet) + word[k:], word[:k] + r.choice(alphabet) + word[k + 1 :]))
            n[word] = max(1, n.get(word, 5 ** r.randint(1, 7)) // r.choice((1, 5, 6)))
    got = rows_of(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == grouped(n) and any(x[2] not in (x[0], x[1]) for x in got)


def test_ways_to_a_root_of_any_length(spark):
    n = {"a" * k + "b" * (30 - k): 5**k for k in range(24)}
    got = rows_of(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == grouped(n) and {x[2] for x in got} == {"a" * 23 + "b" * 7}


def test_words_of_messy_texts(spark, monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh\u00e9\u00d7\u00c0") for _ in range(r.randint(4, 9))) for _ in range(40)]
    words += [w[:3] + w[4:] for w in words[:20]] + ["Wordings", "WORDINGS", "wordingS", "na\u00efvely", "NA\u00cfVELY"]
    rows = [(i, r.choice((" ", "\n", "1", "_", "\u0100", "")).join(r.choice(words) for _ in range(60)), None, "s", 0) for i in range(120)]
    rows += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (None, "abcdefgh " * 900, "en", "s", 0), rows[0], rows[0], (502, "x" * 100000 + " " + "abcdefgh " * 50000, "en", "s", 0)]
    monkeypatch.setattr(queries, "load", lambda *_: messy(spark, rows))
    n = counted(rows)
    assert rows_of(queries.op12_spelling_variants(spark, "")) == grouped(n) and len(n) > 40
    monkeypatch.setattr(queries, "load", lambda *_: messy(spark, []))
    assert not rows_of(queries.op12_spelling_variants(spark, ""))


def test_null_words_and_small_ratios(spark):
    rows = spark.createDataFrame([(None, 9), ("abcdef", None), ("abcdeg", 3)], "word string, n long")
    assert rows_of(spelling.variants(rows)) == [("abcdeg", "", "abcdeg", 3, 0, 0)]
    with pytest.raises(ValueError):
        spelling.variants(rows, 1)
