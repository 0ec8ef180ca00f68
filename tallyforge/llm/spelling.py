"""Spelling variants: words one edit apart, grouped under the form that is much more frequent.

Symmetric deletes: every word emits itself and its distinct deletions of one
character as keys, and words that share a key meet in an equi-join. Words one
insertion or deletion apart share the shorter word, words one replacement
apart what both have without that place, and such a pair shares no other key;
so each near pair meets exactly once. What meets is verified by its edit
distance. A key is shared by at most as many words as its length and the
alphabet allow, however large the corpus. Counts and the best form of each
word are aggregates over its near words; roots come from joining the forms
with themselves, which doubles the length of the way with each round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A run of letters of at least six, after A-Z were lower-cased.
LETTERS = r"[a-zÀ-ÿ]{%d,}"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 6, often: int = 5, spelled: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``word, n``: words of at least ``length`` letters that occur at least ``often`` times in whole texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are
    lower-cased. ``spelled(id, run)`` may say how a run counts. Null and empty
    texts have no words; rows repeated count each; no rows give no words;
    other columns are not looked at. Counts are summed where the texts are
    before they move.
    """
    lower = F.translate(F.col(text_col).cast("string"), _UPPER, _UPPER.lower())
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS % length), F.lit(0))).alias("run"))
    words = runs.select((spelled(F.col("id"), F.col("run")) if spelled else F.col("run")).alias("word")).filter(F.char_length("word") >= length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


def _near(words: DataFrame) -> DataFrame:
    """``word, other, m`` both ways for words one edit apart; ``m`` is the other's count."""
    shorter = F.expr("transform(sequence(1, char_length(word)), i -> concat(left(word, i - 1), substring(word, i + 1)))")
    keys = words.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), shorter))).alias("key"))
    a, b = (keys.select("key", F.col("word").alias(f"{x}_word"), F.col("n").alias(f"{x}_n")) for x in "ab")
    pairs = a.join(b, "key").filter((F.col("a_word") < F.col("b_word")) & (F.levenshtein("a_word", "b_word", 1) == 1))
    way = lambda x, y: F.struct(F.col(f"{x}_word").alias("word"), F.col(f"{y}_word").alias("other"), F.col(f"{y}_n").alias("m"))
    return pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``, which has no cycle: the ways double until none goes on."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(at)
        at = step.select("word", "root")
        at.stored_at = step.stored_at
        if step.filter("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for distinct ``word, n``.

    ``n_near`` words are exactly one inserted, deleted or replaced character
    away. ``form`` is the one of them with the largest count (of equal ones
    the first in code-point order) if that is at least ``ratio`` times the
    word's, else null; ``root`` is where following forms ends. With a ratio of
    2 or more forms cannot go round. Null words and counts are left out; an
    empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("the ratio must be 2 at least")
    words = stored(words.filter("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best")
    near = _near(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(near, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= F.lit(ratio) * F.col("n"), -F.col("best.m")))
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "form_n"), "spelling-forms")
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
