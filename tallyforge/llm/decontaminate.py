"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap checks.

The inverted index holds the benchmark's items; every passage of every
document is a query. A posting's impact is its BM25 weight over the item's
score against its own text, so one threshold in (0, 1] serves all items.

An entry's commonest terms, as many as together stay under half the threshold,
are not essential to it: an entry that reaches the threshold has the rest of it
from its other, rarer terms. Only these have postings to walk. They lie in
blocks of entries and each block keeps each term's highest impact; for many
passages at once, blocks whose summed maxima cannot give what some entry of
theirs needs are skipped, and in the others each entry's own sum is held
against what it needs. What is left of a passage's entries goes through WAND
over all their terms: lists ordered by their next entry, a pivot where their
maxima reach the threshold, the pivot's block tested by its own maxima, and
skips past what neither can reach. All bounds are exact, so all items above the
threshold come back, and the work follows the rarer terms of a passage, not the
words that it shares with every item.
An item longer than a stride is indexed whole and in overlapping parts of
one stride, each over its own score: a copy of a part lies in one passage,
however long the item is.
Each is then verified near where it scored (its passages and a stride on either
side): shares of the question's and of the answer's word runs that occur there,
or of all runs where nothing is asked.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, stored
from .texthash import LOWER, SPACES, give_back, mix64, raw_texts, slices, word_hashes, word_starts

#: BM25's k1 and b.
K1, B = 1.2, 0.75
#: A passage is two strides long; strides overlap by half of it.
STRIDE = 64
#: Words from one part of a long item to the next.
PART_STEP = STRIDE // 2
#: Entries (items and parts of long ones) in a posting block, and in one index: more make more indexes.
BLOCK, INDEX_ITEMS = 8, 20_000
#: Share of the threshold that terms which are not essential may give.
COMMON = 0.5
#: Indexes that are broadcast together; a benchmark of more is searched in several scans, each built, used and freed before the next.
WAVE = 4
THRESHOLD, OVERLAP = 0.5, 0.6
#: Words in a run for the overlap checks.
RUN = 5
_BYTES = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(4)
_EPS = 1e-9
#: Cells of a table of bounds.
_CELLS = 1 << 20
_STEP = _rng.integers(1, 2**63, RUN, dtype=np.uint64) * _U(2) + _U(1)

_BLANK = " \t\n\x0b\x0c\r"
#: Words end at ASCII white space and ASCII punctuation.
GAPS = SPACES.copy()
GAPS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a batch, and each text's bounds among them."""
    raw, bounds = raw_texts(text)
    raw = LOWER[raw]
    raw = np.where(GAPS[raw], np.uint8(32), raw)
    starts = word_starts(raw, bounds)
    return word_hashes(raw, starts), np.searchsorted(starts, bounds)


def hashes_of(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each ``k`` words in a row."""
    n = len(words)
    if n < k or not k:
        return np.zeros(0, dtype=np.uint64)
    total = words[: n - k + 1] * _STEP[0]
    for i in range(1, k):
        total = total + words[i : n - k + 1 + i] * _STEP[i]
    return mix64(total + _U(k))


def runs_of(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(hashes_of(words, k))


def asks(text: str) -> bool:
    """Whether something follows a '?'; else the two parts are one statement, cut at its last sentence."""
    return "?" in text.strip(_BLANK)[:-1]


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is what follows the last '?', else the last sentence, else nothing."""
    body = text.strip(_BLANK)
    if asks(body):
        cut = body.rindex("?", 0, len(body) - 1) + 1
    else:
        ends = [m.end() for m in re.finditer(r"[.!][\x20\x09-\x0D]+|\n+", body)]
        cut = ends[-1] if ends else len(body)
    return body[:cut], body[cut:]


def entries(n: int) -> list[tuple[int, int]]:
    """Bounds of what is indexed of an item of ``n`` words: the whole and, if it is longer than a stride, its parts."""
    parts = [*range(0, n - STRIDE, PART_STEP), n - STRIDE] if n > STRIDE else []
    return [(0, n), *((a, a + STRIDE) for a in parts)]


@dataclass(frozen=True)
class Index:
    """Entries, each an item or a part of one, with their terms (rows of ``vocabulary``, sorted hashes) and postings of essential ones."""

    items: np.ndarray  # of each entry: the item's id, null too
    item: np.ndarray  # of each entry: the row of ``parts``
    vocabulary: np.ndarray
    need: np.ndarray  # of each entry: what essential terms must give
    block_need: np.ndarray  # the least of it in each block
    block_start: np.ndarray  # CSR by term
    block: np.ndarray
    block_most: np.ndarray
    post_start: np.ndarray  # CSR by row of ``block``
    post_item: np.ndarray
    post_impact: np.ndarray
    entry_start: np.ndarray  # CSR by entry: all its terms
    entry_term: np.ndarray
    entry_impact: np.ndarray
    ids: list[int | None]
    parts: list[tuple[tuple[int, np.ndarray], ...]]  # of each item, for question, answer and, if it does not ask, the whole: the run length and the runs
    filter_bits: np.ndarray


def build_index(items: list[tuple[int | None, str]], n_all: int, df_all: dict[int, int], mean_len: float, threshold: float) -> Index:
    split = [question_and_answer(t) for _, t in items]
    words, ends = terms(pa.array([t for _, t in items], pa.string()))
    whole = [words[ends[i] : ends[i + 1]] for i in range(len(items))]
    bounds = [(i, a, b) for i, w in enumerate(whole) for a, b in entries(len(w))]
    item = np.array([i for i, _, _ in bounds], dtype=np.int64)
    vocabulary = np.unique(words)
    df = np.array([df_all[t] for t in vocabulary.tolist()], dtype=np.float64)
    idf = np.log(1 + (n_all - df + 0.5) / (df + 0.5))
    entry_terms, entry_impacts, needs, post = [], [], [], []
    for e, (i, a, b) in enumerate(bounds):
        t, c = np.unique(whole[i][a:b], return_counts=True)
        t = np.searchsorted(vocabulary, t)
        w = idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * (b - a) / mean_len))
        w = w / w.sum()
        common = np.lexsort((t, -df[t]))
        held = np.cumsum(w[common])
        n = int(np.searchsorted(held, COMMON * threshold, side="right"))
        needs.append(threshold - (held[n - 1] if n else 0.0) - _EPS)
        post += [(k, e, w[x]) for x, k in zip(common[n:].tolist(), t[common[n:]].tolist(), strict=True)]
        entry_terms.append(t)
        entry_impacts.append(w)
    term, entry, impact = (np.array(x) for x in zip(*sorted(post), strict=True))
    opens = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (entry[1:] // BLOCK != entry[:-1] // BLOCK)))
    need = np.array(needs)
    padded = np.append(need, np.full(-len(need) % BLOCK, np.inf))
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(vocabulary >> _U(44)).astype(np.int64)] = True
    q, qe = terms(pa.array([s[0] for s in split], pa.string()))
    a, ae = terms(pa.array([s[1] for s in split], pa.string()))
    parts = []
    for i in range(len(items)):
        checked = [q[qe[i] : qe[i + 1]], a[ae[i] : ae[i + 1]], *([] if asks(items[i][1]) else [whole[i]])]
        parts.append(tuple((min(len(w), RUN), runs_of(w, min(len(w), RUN))) for w in checked))
    return Index(
        np.array([i for i, _ in items], dtype=object)[item], item, vocabulary, need, padded.reshape(-1, BLOCK).min(axis=1),
        np.searchsorted(term[opens], np.arange(len(vocabulary) + 1)), entry[opens] // BLOCK, np.maximum.reduceat(impact, opens),
        np.append(opens, len(term)), entry, impact,
        np.append(0, np.cumsum([len(t) for t in entry_terms])), np.concatenate(entry_terms), np.concatenate(entry_impacts), [i for i, _ in items], parts, bits,
    )


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of range(start, end) in a row, and which pair each comes from."""
    n = ends - starts
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n), of


def wand(lists: list[list[tuple[int, float]]], threshold: float) -> list[tuple[int, float]]:
    """(entry, score) for every entry whose postings (entry, impact) in ``lists``, one for each term, reach the threshold: block-max WAND."""
    items, impacts = [[e for e, _ in x] for x in lists], [[w for _, w in x] for x in lists]
    blocks: list[dict[int, float]] = []
    for x in lists:
        blocks.append({})
        for e, w in x:
            blocks[-1][e // BLOCK] = max(w, blocks[-1].get(e // BLOCK, 0.0))
    most = [max(b.values()) for b in blocks]
    at, out, need = [0] * len(lists), [], threshold - _EPS
    while True:
        ahead = sorted((x[at[i]], i) for i, x in enumerate(items) if at[i] < len(x))
        bound, pivot = 0.0, None
        for entry, i in ahead:
            bound += most[i]
            if bound >= need:
                pivot = entry
                break
        if pivot is None:
            return out
        block = pivot // BLOCK
        here = [i for entry, i in ahead if entry <= pivot]
        if sum(blocks[i].get(block, 0.0) for i in here) < need:
            # Nothing before the block's end can reach it, unless a list that lies ahead joins in.
            to = min((block + 1) * BLOCK, ahead[len(here)][0]) if len(here) < len(ahead) else (block + 1) * BLOCK
        elif ahead[0][0] == pivot:
            score = sum(impacts[i][at[i]] for i in here)
            if score >= need:
                out.append((pivot, score))
            to = pivot + 1
        else:
            to = pivot
        for i in here:
            at[i] = bisect_left(items[i], to, at[i])


def candidates(index: Index, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nth passage, entry) that may reach the threshold, by essential terms; ``passage`` ascends and its terms are distinct."""
    n_blocks = len(index.block_need)
    nth = np.cumsum(np.append(False, passage[1:] != passage[:-1]))
    out_p, out_e = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = max(1, _CELLS // n_blocks)
    cuts = np.searchsorted(nth, np.arange(0, nth[-1] + 1 + size, size))
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        row, of = _spread(index.block_start[term[a:z]], index.block_start[term[a:z] + 1])
        cell = (nth[a:z] - k * size)[of] * n_blocks + index.block[row]
        bound = np.bincount(cell, weights=index.block_most[row], minlength=size * n_blocks)
        live = bound.reshape(-1, n_blocks) >= index.block_need
        number = np.cumsum(live.ravel()) - 1
        held = live.ravel()[cell]
        row, cell = row[held], cell[held]
        post, of = _spread(index.post_start[row], index.post_start[row + 1])
        total = np.bincount(number[cell[of]] * BLOCK + index.post_item[post] % BLOCK, weights=index.post_impact[post], minlength=int(live.sum()) * BLOCK)
        p, block = np.nonzero(live)
        entry = (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        good = np.flatnonzero((entry < len(index.need)) & (total >= np.append(index.need, np.full(BLOCK, np.inf))[np.minimum(entry, len(index.need))]))
        out_p.append(p[good // BLOCK] + k * size)
        out_e.append(entry[good])
    return np.concatenate(out_p), np.concatenate(out_e)


def retrieve(index: Index, words: np.ndarray, ends: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, passage, entry, score) for every entry that a passage of a text scores at or above the threshold.

    Passage j of a text is its strides of words j - 1 and j.
    """
    none = (*[np.zeros(0, np.int64)] * 3, np.zeros(0))
    at = np.flatnonzero(index.filter_bits[(words >> _U(44)).astype(np.int64)])
    if not len(at) or not len(index.vocabulary):
        return none
    term = np.searchsorted(index.vocabulary, words[at])
    term[term == len(index.vocabulary)] = 0
    good = index.vocabulary[term] == words[at]
    at, term = at[good], term[good]
    if not len(at):
        return none
    text = np.searchsorted(ends, at, side="right") - 1
    # Passage j of a text begins with its stride j - 1, so a word in stride s is in passages s and s + 1.
    first = np.append(0, np.cumsum(-(-np.diff(ends) // STRIDE) + 1))
    own = first[text] + (at - ends[text]) // STRIDE
    pairs = np.sort(np.concatenate([own, own + 1]) * len(index.vocabulary) + np.concatenate([term, term]))
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
    passage, term = pairs // len(index.vocabulary), pairs % len(index.vocabulary)
    starts = np.append(np.flatnonzero(np.append(True, passage[1:] != passage[:-1])), len(passage))
    nth, entry = candidates(index, passage, term)
    out = []
    for a, z in zip(*(lambda o: (o[:-1].tolist(), o[1:].tolist()))(np.append(np.flatnonzero(np.append(True, nth[1:] != nth[:-1]))[: len(nth)], len(nth))), strict=True):
        there = term[starts[nth[a]] : starts[nth[a] + 1]]
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for e in entry[a:z].tolist():
            own = slice(index.entry_start[e], index.entry_start[e + 1])
            k = np.searchsorted(there, index.entry_term[own])
            met = there[np.minimum(k, len(there) - 1)] == index.entry_term[own]
            for t, w in zip(index.entry_term[own][met].tolist(), index.entry_impact[own][met].tolist(), strict=True):
                lists[t].append((e, w))
        p = int(passage[starts[nth[a]]])
        t = int(np.searchsorted(first, p, side="right")) - 1
        out += [(t, p - int(first[t]), e, score) for e, score in wand(list(lists.values()), threshold)]
    if not out:
        return none
    text, place, entry, score = zip(*out, strict=True)
    return np.array(text), np.array(place), np.array(entry), np.array(score)


class _Runs:
    """Where runs of words begin in a text; hashed and sorted once for each length of run."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.known = words, {}

    def share(self, k: int, runs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> float:
        """Share of ``runs`` (of ``k`` words) that lie in one of the stretches from ``starts`` to ``ends``, which are apart."""
        if not len(runs):
            return 1.0
        if k not in self.known:
            h = hashes_of(self.words, k)
            order = np.argsort(h, kind="stable")
            self.known[k] = h[order], order
        h, order = self.known[k]
        at, of = _spread(np.searchsorted(h, runs), np.searchsorted(h, runs, side="right"))
        place = order[at]
        stretch = np.searchsorted(starts, place, side="right") - 1
        inside = (stretch >= 0) & (place + k <= ends[stretch])
        return len(np.unique(of[inside])) / len(runs)


def _leaks(index: Index, text: pa.Array, threshold: float, overlap: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(text))]
    for a, b in slices(text, _BYTES):
        words, ends = terms(text.slice(a, b - a))
        best: dict[tuple[int, int], float] = {}
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, place, entry, score in zip(*retrieve(index, words, ends, threshold), strict=True):
            key = int(i), int(index.item[entry])
            best[key] = max(score, best.get(key, 0.0))
            places[key].add(int(place))
        own, runs = -1, None
        for i, item in sorted(best):
            if i != own:
                own, runs = i, _Runs(words[ends[i] : ends[i + 1]])
            # The strides of its passages and one on either side; stretches that touch are one.
            near = np.array(sorted(places[i, item])) * STRIDE
            apart = np.flatnonzero(np.diff(near) > 4 * STRIDE)
            starts, stops = near[np.append(0, apart + 1)] - 2 * STRIDE, near[np.append(apart, len(near) - 1)] + 2 * STRIDE
            question, answer, *statement = (runs.share(k, part, starts, stops) for k, part in index.parts[item])
            if max([min(question, answer), *statement]) >= overlap:
                out[a + i].append({"item_id": index.ids[item], "score": float(best[i, item]), "question_overlap": question, "answer_overlap": answer})
    return out


LEAK = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>"


def _leak_column(shared: Broadcast, threshold: float, overlap: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def leaks(text: pa.Array) -> pa.Array:
        found = pa.array(_leaks(shared.value, text, threshold, overlap), kind)
        give_back()
        return found

    leaks.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(leaks, LEAK)


def _item_terms(text: pa.Array) -> pa.Array:
    """For each text its number of words and its distinct terms."""
    words, ends = terms(text)
    own = [words[ends[i] : ends[i + 1]] for i in range(len(text))]
    return pa.StructArray.from_arrays([pa.array(map(len, own), pa.int64()), pa.array([np.unique(w).view(np.int64).tolist() for w in own], pa.list_(pa.int64()))], ["n", "terms"])


_item_terms.__annotations__ = {"text": pa.Array, "return": pa.Array}


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD, most: int = INDEX_ITEMS) -> Iterator[Index]:
    """The benchmark's indexes, at most ``most`` entries in each; term statistics are those of all items.

    Document frequencies are counted by Spark and come with each item's terms;
    the driver holds one index's items at a time. All entries of an item are
    in one index; an item of more than ``most`` has its own.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    rows = rows.select("item_id", "text", F.arrow_udf(_item_terms, "struct<n:long,terms:array<long>>")("text").alias("x")).select("item_id", "text", "x.*").filter("n > 0")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "bench-items")
    whole = rows.agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean")).first()
    each = rows.select("row", F.explode("terms").alias("term"))
    counted = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = each.join(counted, "term").groupBy("row").agg(F.collect_list(F.struct("term", "df")).alias("df"))
    pack, room = [], most
    df: dict[int, int] = {}
    for r in rows.join(found, "row").select("item_id", "text", "n", "df").orderBy("item_id", "text").toLocalIterator():
        need = len(entries(r["n"]))
        if pack and need > room:
            yield build_index(pack, whole["items"], df, whole["mean"], threshold)
            pack, room, df = [], most, {}
        pack.append((r["item_id"], r["text"]))
        df.update((x["term"] % 2**64, x["df"]) for x in r["df"])
        room -= need
    if pack:
        yield build_index(pack, whole["items"], df, whole["mean"], threshold)


def _waves(docs: DataFrame, benchmark: DataFrame, threshold: float, overlap: float, most: int) -> Iterator[tuple[Column, list[Broadcast], bool]]:
    """A function of the text for each wave of indexes (the items of the wave that it contains), what it reads, and whether it is the last.

    The next wave is built when the caller is done with the one before.
    """
    lean(docs.sparkSession)
    left = indexes(benchmark, threshold=threshold, most=most)
    ahead = next(left, None)
    while True:
        wave: list[Broadcast] = []
        while ahead is not None and len(wave) < WAVE:
            wave.append(docs.sparkSession.sparkContext.broadcast(ahead))
            ahead = next(left, None)
        yield (lambda text, wave=wave: F.concat(F.array().cast(LEAK), *[_leak_column(x, threshold, overlap)(text) for x in wave])), wave, ahead is None
        if ahead is None:
            return


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, most: int = INDEX_ITEMS) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, all columns as they were.

    Nulls, blanks, repeats, long texts and items are as in ``contaminated``; an
    empty table stays empty. Nothing is shuffled. A benchmark of more than
    ``WAVE`` indexes is searched wave by wave, each over what the one before kept.
    """
    for leaks, wave, last in _waves(docs, benchmark, threshold, overlap, most):
        docs = docs.filter(F.size(leaks(F.col(text_col).cast("string"))) == 0)
        if not last:
            docs = stored(docs, "leak-wave")
            for index in wave:
                index.destroy()
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, most: int = INDEX_ITEMS) -> DataFrame:
    """(``id_col``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``): one row for each item a document contains.

    ``score`` is the best that a passage reaches against the item or a part of it.

    Nothing is shuffled: each document is split into passages and asked where
    it lies, whole, however long. Null, empty and blank texts hold nothing;
    rows repeated give their items each; a null id is kept; other columns are
    not looked at; an empty table or benchmark gives no rows. Items without a
    word are left out, as are null texts. Every different text is an item of
    its own: an id with several texts, null too, comes once for each that is
    found. An answer or question without words counts as found; a question
    without its answer near it is no leak. An item that asks nothing is found
    by a share of all its runs as well.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for leaks, wave, last in _waves(docs, benchmark, threshold, overlap, most):
        found = rows.select("id", leaks(F.col("text")).alias("leaks")).select(F.col("id").alias(id_col), F.inline("leaks"))
        if not last:
            found = stored(found, "leak-wave")
            for index in wave:
                index.destroy()
        out = found if out is None else out.union(found)
    return out
