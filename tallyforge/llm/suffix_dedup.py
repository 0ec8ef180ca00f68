"""Repeated passages by suffix sorting over bytes.

A string of ``length`` bytes that starts in two places is a repeat. Sorting
one suffix for each byte would move every text hundreds of times, so suffixes
are sorted only where repeats can be, without losing one:

1. Every window of ``length`` bytes names one of its 32-byte grams, the
   leftmost of least hash. Equal windows name the same gram at the same
   place, so a repeat shows as a repeated gram ("anchor"). The windows that
   name one anchor are consecutive; together they cover its span.
2. Anchors whose gram is unique have no repeats. Where another anchor has the
   same whole span, all its windows repeat. What remains are the ends of
   repeats: anchors whose gram repeats, whose span does not.
3. For those, the suffixes that start at the anchor (and one for each whole
   span that repeats) are dealt by sampled splitters into ranges of their
   leading bytes, each range is sorted by a multikey sort on 8-byte words,
   and neighbours are compared, also across range boundaries. A second order,
   by gram and then by the bytes before it, right to left, gives the longest
   match on that side. A window that neither neighbour proves, yet both
   bounds allow, is settled by grouping hashes of such windows.
4. Proven windows of a document are merged and cut from its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, join_counted, lean, range_samples, shuffle_parts, stored
from .texthash import mix64, raw_texts, slices, tidy

GRAM = 32
#: Window starts, and bytes of texts, handled at once; bounds the working arrays.
CHUNK = 1 << 20
#: Suffixes of one range, which a task sorts in memory (about 2 KB each), and keys sampled for it (about 400 bytes each).
RANGE_ROWS, RANGE_SAMPLES = 50_000, 12
_U = np.uint64
_rng = np.random.default_rng(99)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_ODD = _U(0x9E3779B97F4A7C15)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each byte on, by doubling."""
    h, width, power = _BYTE[raw], 1, _ODD
    while width < GRAM:
        h = h[:-width] + h[width:] * power
        power, width = _U(int(power) ** 2 % 2**64), width * 2
    return mix64(h)


def _window_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of its least, leftmost of equals."""
    n = len(hashes)
    key = (hashes & ~_U(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:n] = key
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & _U(0xFFFFFF)).astype(np.int64)


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, place, least, most, gram): anchors of a batch.

    The windows that name the anchor start from ``most`` down to ``least``
    bytes before ``place`` (a place in ``raw``).
    """
    width = length - GRAM + 1
    parts = []
    for a in range(0, max(0, len(raw) - length + 1), CHUNK):
        piece = raw[a : a + CHUNK + length - 1]
        hashes = _gram_hashes(piece)
        parts.append((_window_anchors(hashes, width) + a, hashes, a))
    if not parts:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    place = np.concatenate([p[0] for p in parts])
    start = np.arange(len(place))
    text = np.searchsorted(bounds, start, side="right") - 1
    inside = start + length <= bounds[text + 1]
    start, place, text = start[inside], place[inside], text[inside]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    at = place[first]
    gram = np.empty(len(at), dtype=np.uint64)
    for _, hashes, a in parts:
        own = (at >= a) & (at < a + len(hashes))
        gram[own] = hashes[at[own] - a]
    return text[first], at, at - start[last], at - start[first], gram


def _anchor_rows(length: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, end in slices(whole.column(2), CHUNK):
                b = whole.slice(i, end - i)
                raw, bounds = raw_texts(b.column(2))
                text, at, least, most, gram = anchors(raw, bounds, length)
                view = memoryview(raw.tobytes())
                span = [xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip((at - most).tolist(), (at - least + length).tolist(), strict=True)]
                spot = ((at - bounds[text]) << 16) | (least << 8) | most
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(spot), pa.array(gram.view(np.int64)), pa.array(np.array(span, dtype=np.uint64).view(np.int64))], ["id", "h", "spot", "gram", "span"])

    return run


@tidy
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        press = zstandard.ZstdCompressor(level=3)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press.compress((t or "").encode()) for t in b.column(2).to_pylist()], pa.binary())], ["id", "h", "z"])


def _suffixes(length: int):
    """Each wanted anchor with the bytes from it on and the bytes before it, right to left."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"id": [], "h": [], "spot": [], "gram": [], "edge": [], "right": [], "left": []}
            for key, h, z, wanted in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text = zstandard.decompress(z)
                for w in wanted:
                    at, least, most = w["spot"] >> 16, (w["spot"] >> 8) & 255, w["spot"] & 255
                    out["id"].append(key)
                    out["h"].append(h)
                    out["spot"].append(w["spot"])
                    out["gram"].append(w["gram"])
                    out["edge"].append(w["edge"])
                    out["right"].append(text[at : at - least + length])
                    out["left"].append(text[at - most : at][::-1])
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], b.schema.field(0).type), pa.array(out["h"], pa.int64()), pa.array(out["spot"], pa.int64()), pa.array(out["gram"], pa.int64()), pa.array(out["edge"], pa.bool_()), pa.array(out["right"], pa.binary()), pa.array(out["left"], pa.binary())], list(out))

    return run


def _grid(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings as rows of equal width, and their lengths."""
    texts = values.to_pylist()
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(len(texts), width), np.array([len(t) for t in texts], dtype=np.int64)


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of bytes: sort by one 8-byte word, then each run of equals by the next word."""
    n, width = keys.shape
    words = np.ascontiguousarray(np.pad(keys, ((0, 0), (0, -width % 8)))).view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    # Each row's rank is the place of the first row of its run.
    rank = np.maximum.accumulate(np.where(np.append(True, first[1:] != first[:-1]), np.arange(n), 0))
    for d in range(1, words.shape[1]):
        run = np.bincount(rank, minlength=n)
        loose = np.flatnonzero(run[rank] > 1)
        if not len(loose):
            break
        rows = order[loose]
        inner = np.lexsort((words[rows, d], rank[loose]))
        order[loose] = rows[inner]
        own = words[order[loose], d]
        step = np.append(True, (rank[loose][1:] != rank[loose][:-1]) | (own[1:] != own[:-1]))
        rank[loose] = loose[np.maximum.accumulate(np.where(step, np.arange(len(loose)), 0))]
    return order


def _common(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many leading bytes agree, row by row, at most ``lengths``."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), lengths)


_MATCH = "id {kind}, h long, spot long, gram long, right_most int, left_most int, proven array<int>, pid int, side int, edge boolean, right binary, left binary"


def _bounds(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (spot >> 8) & 255, spot & 255


def _match_rows(length: int, by_left: bool):
    """Sort one range, compare neighbours; the first and last row come back whole for the boundaries."""
    most_left = length - GRAM

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks().to_batches()[0]
        right, right_n = _grid(t.column("right"), length)
        left, left_n = _grid(t.column("left"), most_left)
        keys = np.hstack([right[:, :GRAM], left, right[:, GRAM:]]) if by_left else np.hstack([right, left])
        order = multikey_order(keys)
        spot = t.column("spot").to_numpy()
        edge = t.column("edge").to_numpy(zero_copy_only=False)
        least, most = _bounds(spot)
        n = len(order)
        a, b = order[:-1], order[1:]
        r = _common(right[a], right[b], np.minimum(right_n[a], right_n[b]))
        ell = _common(left[a], left[b], np.minimum(left_n[a], left_n[b]))
        ell[r < GRAM] = -1
        r[r < GRAM] = -1
        best_r, best_l = np.full(n, -1), np.full(n, -1)
        proven = np.full((n, 4), -1)
        for slot, own in ((0, a), (2, b)):
            best_r[own] = np.maximum(best_r[own], r)
            best_l[own] = np.maximum(best_l[own], ell)
            lo, hi = np.maximum(least[own], length - r), np.minimum(most[own], ell)
            good = (r >= GRAM) & (lo <= hi)
            proven[own[good], slot] = lo[good]
            proven[own[good], slot + 1] = hi[good]
        rows = np.flatnonzero(edge)
        pid = t.column("pid")[0].as_py()
        ends = np.array([order[0], order[-1]])
        take = np.concatenate([rows, ends])
        inner = len(rows)
        side = pa.array([0] * inner + [1, 2], pa.int32())
        none = pa.array([None] * inner, pa.binary())
        full = pa.array(take)
        lists = pa.array([[int(x) for x in proven[i] if x >= 0] for i in rows] + [[], []], pa.list_(pa.int32()))
        best = lambda v: pa.array(np.append(v[rows], [-1, -1]), pa.int32())
        text = lambda c: pa.concat_arrays([none, t.column(c).take(pa.array(ends))])
        yield pa.RecordBatch.from_arrays(
            [t.column("id").take(full), t.column("h").take(full), t.column("spot").take(full), t.column("gram").take(full), best(best_r), best(best_l), lists, pa.array([pid] * len(take), pa.int32()), side, t.column("edge").take(full), text("right"), text("left")],
            ["id", "h", "spot", "gram", "right_most", "left_most", "proven", "pid", "side", "edge", "right", "left"],
        )

    return run


def _across(length: int):
    """Compare the last row of a range with the first of the next one that has rows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            out: dict[str, list] = {n: [] for n in ("id", "h", "spot", "gram", "right_most", "left_most", "proven")}
            for i in range(len(b)):
                x = (cols["right"][i], cols["left"][i])
                y = (cols["other_right"][i], cols["other_left"][i])
                r, ell = (next((k for k, (p, q) in enumerate(zip(u, v)) if p != q), min(len(u), len(v))) for u, v in zip(x, y))
                if r < GRAM:
                    continue
                for pre in ("", "other_"):
                    if cols[f"{pre}edge"][i]:
                        spot = cols[f"{pre}spot"][i]
                        lo, hi = max((spot >> 8) & 255, length - r), min(spot & 255, ell)
                        for n in ("id", "h", "spot", "gram"):
                            out[n].append(cols[pre + n][i])
                        out["right_most"].append(r)
                        out["left_most"].append(ell)
                        out["proven"].append([lo, hi] if lo <= hi else [])
            kind = b.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], kind), *(pa.array(out[n], pa.int64()) for n in ("h", "spot", "gram")), pa.array(out["right_most"], pa.int32()), pa.array(out["left_most"], pa.int32()), pa.array(out["proven"], pa.list_(pa.int32()))], list(out))

    return run


def _left_over(length: int):
    """The hull of the windows that both bounds allow and no neighbour proves, where there are any."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            keep, lo_out, hi_out = [], [], []
            for i, (spot, r, ell, proven) in enumerate(zip(cols["spot"], cols["right_most"], cols["left_most"], cols["proven"], strict=True)):
                lo, hi = max((spot >> 8) & 255, length - r), min(spot & 255, ell)
                if r < GRAM or lo > hi:
                    continue
                for s, e in sorted(zip(proven[::2], proven[1::2])):
                    if s <= lo:
                        lo = max(lo, e + 1)
                for s, e in sorted(zip(proven[::2], proven[1::2]), key=lambda x: -x[1]):
                    if e >= hi:
                        hi = min(hi, s - 1)
                if lo <= hi:
                    keep.append(i)
                    lo_out.append(lo)
                    hi_out.append(hi)
            rows = pa.array(keep, pa.int64())
            names = ("id", "h", "spot", "gram")
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)).take(rows) for n in names), pa.array(lo_out, pa.int32()), pa.array(hi_out, pa.int32())], [*names, "lo", "hi"])

    return run


def _windows(length: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            rows, back, win = [], [], []
            for i, (spot, right, left) in enumerate(zip(cols["spot"], cols["right"], cols["left"], strict=True)):
                span = left[::-1] + right
                for k in range(max(cols["lo"][i], (spot >> 8) & 255), min(cols["hi"][i], spot & 255) + 1):
                    s = len(left) - k
                    rows.append(i)
                    back.append(k)
                    win.append(xxhash.xxh3_128_digest(span[s : s + length]))
            take = pa.array(rows, pa.int64())
            names = ("id", "h", "spot", "edge")
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)).take(take) for n in names), pa.array(back, pa.int32()), pa.array(win, pa.binary())], [*names, "back", "win"])

    return run


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, spans, kept = [], [], []
        for z, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            text = zstandard.decompress(z)
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            size.append(len(text))
            spans.append([{"start": s, "end": e} for s, e in merged])
            ends = [0, *(x for m in merged for x in m), len(text)]
            kept.append(b"".join(text[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """One row for each input row: ``id_col``, ``n_bytes``, ``spans`` (start, end), ``kept`` (bytes).

    ``spans`` are the maximal runs of bytes that lie in a string of ``length``
    bytes (64 to 255) which also starts elsewhere, in the same text or
    another; ``kept`` is the rest, joined. Matches do not cross documents.

    Null text is empty. Rows repeated with one id and text are documents like
    any other: their strings all repeat. Rows of one id with different texts
    are apart; a null id is an id. An empty table gives an empty result; other
    columns are not looked at. No text or group is handled whole but a
    document's own; ranges split groups of equal suffixes.
    """
    if not 2 * GRAM <= length <= 255:
        raise ValueError("length must be from 64 to 255")
    spark = docs.sparkSession
    lean(spark)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    packed = stored(base.mapInArrow(_packed, f"id {kind}, h long, z binary"), "suffix-texts", "none")

    found = stored(base.mapInArrow(_anchor_rows(length), f"id {kind}, h long, spot long, gram long, span long"), "suffix-anchors")
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi")).filter("n > 1")
    grams = stored(grams.select("gram", (F.col("lo") == F.col("hi")).alias("alike"), "n"), "suffix-grams")
    # A passage that very many documents share has hot grams.
    again = stored(join_counted(found, grams, ["gram"], "n"), "suffix-repeats")
    discard(found, grams)

    mixed = again.filter("NOT alike")
    spans = stored(mixed.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "spot")).alias("one")), "suffix-spans")
    whole = again.filter("alike").select("id", "h", "spot").union(join_counted(mixed, spans.filter("n > 1").select("gram", "span", "n"), ["gram", "span"], "n").select("id", "h", "spot"))
    at, least, most = F.shiftright("spot", 16), F.shiftright("spot", 8).bitwiseAND(255), F.col("spot").bitwiseAND(255)
    pieces = whole.select("id", "h", (at - most).alias("s"), (at - least + length).alias("e"))

    wanted = spans.select("one.id", "one.h", F.struct(F.col("one.spot").alias("spot"), "gram", (F.col("n") == 1).alias("edge")).alias("w"))
    wanted = wanted.groupBy("id", "h").agg(F.collect_list("w").alias("wanted"))
    texts = packed.join(wanted.withColumnsRenamed({"id": "wid", "h": "wh"}), packed["id"].eqNullSafe(F.col("wid")) & (packed["h"] == F.col("wh"))).select("id", "h", "z", "wanted")
    # Rows repeated with one id and text name the same anchors: one of them is enough.
    suffixes = stored(texts.mapInArrow(_suffixes(length), f"id {kind}, h long, spot long, gram long, edge boolean, right binary, left binary"), "suffix-rows")

    parts = max(shuffle_parts(spark), suffixes.count() // RANGE_ROWS + 1)
    compared = []
    for by_left in (False, True):
        lead = [F.substring("right", 1, GRAM), "left", F.substring("right", GRAM + 1, length)] if by_left else ["right", "left"]
        dealt = suffixes.repartitionByRange(parts, *lead).withColumn("pid", F.spark_partition_id())
        with range_samples(spark, RANGE_SAMPLES):
            rows = stored(dealt.mapInArrow(_match_rows(length, by_left), _MATCH.format(kind=kind)), "suffix-matches")
        compared.append(rows.filter("side = 0").select("id", "h", "spot", "gram", "right_most", "left_most", "proven"))
        names = ["id", "h", "spot", "gram", "edge", "right", "left"]
        # The last row of a range meets the first of the next one by that one's number; only the numbers of ranges are put in order.
        after = rows.filter("side = 2").select("pid").withColumn("next", F.lead("pid").over(W.orderBy("pid"))).filter("next IS NOT NULL")
        first = rows.filter("side = 1").select(F.col("pid").alias("next"), *[F.col(n).alias(f"other_{n}") for n in names])
        ends = rows.filter("side = 2").select("pid", *names).join(after, "pid").join(first, "next").drop("pid", "next")
        compared.append(ends.mapInArrow(_across(length), f"id {kind}, h long, spot long, gram long, right_most int, left_most int, proven array<int>"))
    joined = compared[0].union(compared[1]).union(compared[2]).union(compared[3])
    edges = stored(joined.groupBy("id", "h", "spot", "gram").agg(F.max("right_most").alias("right_most"), F.max("left_most").alias("left_most"), F.flatten(F.collect_list("proven")).alias("proven")), "suffix-edges")
    pairs = edges.filter(F.size("proven") > 0).select("id", "h", "spot", F.posexplode("proven").alias("i", "lo"), "proven").filter("i % 2 = 0").withColumn("hi", F.get("proven", F.col("i") + 1))
    pieces = pieces.union(pairs.select("id", "h", (at - F.col("hi")).alias("s"), (at - F.col("lo") + length).alias("e")))

    rest = edges.mapInArrow(_left_over(length), f"id {kind}, h long, spot long, gram long, lo int, hi int")
    hull = rest.groupBy("gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    hull = stored(hull.join(suffixes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram"), "suffix-hulls")
    windows = join_counted(suffixes, hull, ["gram"], "n").select("id", "h", "spot", "edge", "right", "left", "lo", "hi").mapInArrow(_windows(length), f"id {kind}, h long, spot long, edge boolean, back int, win binary")
    windows = stored(windows, "suffix-windows")
    discard(suffixes)
    twice = stored(windows.groupBy("win").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-twice")
    settled = join_counted(windows.filter("edge"), twice, ["win"], "n").select("id", "h", (at - F.col("back")).alias("s"), (at - F.col("back") + length).alias("e"))
    pieces = pieces.union(settled)

    cuts = pieces.groupBy("id", "h").agg(F.collect_set(F.struct("s", "e")).alias("cuts"))
    cuts = cuts.withColumnsRenamed({"id": "cid", "h": "ch"})
    out = packed.join(cuts, packed["id"].eqNullSafe(F.col("cid")) & (packed["h"] == F.col("ch")), "left").select("id", "z", "cuts")
    out = out.mapInArrow(_cut, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
