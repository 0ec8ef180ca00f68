"""Near-duplicate detection: MinHash, banding, signature verification, full sets, components.

1. Every document becomes its set of word shingles, a 128-bit hash of the
   whole set, a signature of minima under random multiply-shift hashes, and
   one key for each band of it. Documents with one set are one class; its
   smallest id stands for it from there on, or a number above all ids where
   that id stands for another class. Classes with an id in common are linked.
2. Classes that share a band key are candidates. They are compared in turns:
   in each bucket one member of every component meets one of the bucket's
   largest component, and components that link are merged (large-star and
   small-star) before the next turn, with other members. A family of n near
   copies so costs about n comparisons, not all its pairs. Turns end when one
   finds no link or spares few pairs, after ``TURNS``, or when buckets hold few
   pairs of different components.
3. For what is left there are two ways, each of which finds all: buckets of
   more than ``FEW`` members are cut finer (members of one bucket that also
   agree in four minima of another band) and compared in full, or members go
   through an exact prefix filter of their shingles. How many comparisons a
   document has in either is counted first. It goes the cheaper way: pages
   with changes of their own the second, pages put together from the same
   paragraphs the first.
4. A candidate pair is verified on its signatures first, with a floor that a
   linked pair misses once in 10^9, and confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, lean, stored
from .components import components
from .texthash import mix64, shingle_set, slices, texts_words, tidy

#: A pair at similarity 0.85 shares no band with probability 7e-9, at 0.8 with 3e-6.
BANDS, ROWS = 32, 5
#: Buckets of more members are cut finer before they are compared in full.
FEW = 8
#: So many pairs a document are compared without a look for fewer.
PAIRS = 4
#: Bytes of texts or sets worked on at once: the working arrays take many times as much.
SLICE = 256 << 10
#: Turns of one comparison for each component of a bucket.
TURNS = 6
#: A turn that leaves less than so many pairs fewer in the buckets for each one compared is the last: a pair stands in several buckets, and most are never compared.
GAIN = 4
#: Up to so many pairs or links are broadcast to the tables that they meet, and worked on in tasks of ``TASK_PAIRS``.
FEW_PAIRS, TASK_PAIRS = 20_000, 2_000
_U = np.uint64
_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BAND = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * _U(2) + _U(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash ``a * x + b`` mod 2^32."""
    low = (shingles >> _U(32)).astype(np.uint32)
    out = np.full(len(_MUL), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 256):
        table = low[i : i + 256, None] * _MUL
        table += _ADD
        np.minimum(out, table.min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the minima; the band's number is part of it."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    return mix64((mix64(rows + _U(1)) * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def agreement_floor(percent: int, miss: float = 1e-9) -> int:
    """How many of the minima must agree: two sets at the similarity ``percent`` agree in fewer with chance ``miss`` at most."""
    n, p, below = len(_MUL), percent / 100, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > miss:
            return k
    return n


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of (id, text) in slices of about ``SLICE`` bytes of text, which bound the working arrays."""
    for b in batches:
        for start, end in slices(b.column(1), SLICE):
            yield b.slice(start, end - start)


def _hashes(s: np.ndarray) -> tuple[int, int]:
    """A set's 128 bits; zeros for the empty set."""
    return tuple(int(mix64(s ^ _U(x)).sum().view(np.int64)) if len(s) else 0 for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def _sketches(shingle: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            words, ends = texts_words(b.column(1), lower=True)
            size, h1, h2, keys, counts, low = [], [], [], [], [], []
            for i in range(len(b)):
                s = shingle_set(words[ends[i] : ends[i + 1]], shingle)
                size.append(len(s))
                one, two = _hashes(s)
                h1.append(one)
                h2.append(two)
                least = minima(s) if len(s) else None
                keys.append(np.zeros(0, np.int64) if least is None else band_keys(least))
                low.append(None if least is None else least.astype(np.uint8).tobytes())
                counts.append(len(keys[-1]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists, pa.array(low, pa.binary())], ["id", "n", "h1", "h2", "keys", "signature"])

    return run


def _sets(shingle: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            words, ends = texts_words(b.column(1), lower=True)
            sets = [shingle_set(words[ends[i] : ends[i + 1]], shingle) for i in range(len(b))]
            hashes = [_hashes(s) for s in sets]
            h1, h2 = (pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1))
            members = pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(map(len, sets), pa.int64()), h1, h2, members], ["n", "h1", "h2", "members"])

    return run


def _agree(floor: int):
    """Pairs whose signatures agree in ``floor`` places or more."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(len(b), -1) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= floor, pa.bool_()))

    return run


def _confirm(percent: int):
    """Pairs whose full sets (sorted hashes) are as similar as a link needs."""

    def linked(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


@tidy
def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shingle of each set, in slices of about ``SLICE`` bytes."""
    for b in batches:
        for a, z in slices(b.column(1), SLICE):
            sets = b.column(1).slice(a, z - a)
            flat = np.frombuffer(b"".join(sets.to_pylist()), np.int64)
            n = np.array([len(x.as_buffer()) // 8 for x in sets])
            of = pa.array(np.repeat(np.arange(a, z), n))
            for i in range(0, len(flat), SLICE // 8):
                yield pa.RecordBatch.from_arrays([b.column(0).take(of.slice(i, SLICE // 8)), pa.array(flat[i : i + SLICE // 8])], ["rep", "token"])


def _classes(full: DataFrame) -> tuple[DataFrame, str]:
    """(``rep``, ``id``, ``n``, ``h1``, ``h2``, ``keys``, ``signature``, ``m``) for each class of ``m`` rows, and the type of ``rep``.

    ``rep`` is unique and no smaller than ``id``, the class's smallest id.
    Where one id is that of several classes, one of them has it as ``rep`` and
    the others have numbers above all ids.
    """
    # Partial aggregation leaves one row for each class and task, however many copies there are.
    one = F.first(F.struct("keys", "signature")).alias("one")
    classes = full.groupBy("n", "h1", "h2").agg(F.min("id").alias("id"), one, F.count(F.lit(1)).alias("m"))
    classes = stored(classes.select("n", "h1", "h2", "id", "one.*", "m"), "near-classes")
    own = F.struct("n", "h1", "h2")
    first = classes.groupBy("id").agg(F.min(own).alias("first"), F.max(own).alias("last")).filter("first <> last").select("id", "first")
    others = classes.join(first, "id").filter(own != F.col("first")).select("n", "h1", "h2", F.monotonically_increasing_id().alias("k"))
    others = stored(others, "near-others")
    most = others.agg(F.max("k")).first()[0]
    if most is None:
        return classes.withColumn("rep", F.col("id")), "bigint"
    last = full.agg(F.max("id")).first()[0]
    kind = "bigint" if last + 1 + most < 2**63 else "decimal(20,0)"
    number = (F.lit(last).cast("decimal(20,0)") + F.col("k") + 1).cast(kind)
    classes = classes.join(others, ["n", "h1", "h2"], "left").withColumn("rep", F.coalesce(number, F.col("id").cast(kind))).drop("k")
    return stored(classes, "near-classes"), kind


def _prefixes(sets: DataFrame, loose: DataFrame, percent: int, kind: str) -> DataFrame:
    """Where documents of ``loose(rep, root)`` may first meet one of another root: (token, rep, root, n, place, main, share).

    An exact prefix filter. All shingles have one order, the rarest among
    these documents first. Two linked documents share a shingle, and at their
    first common one each still has as many shingles left as a link needs, so
    only the first few of each document (15 in 100 at a similarity of 0.85)
    can be it. A shingle of one document alone stands before all others and
    meets nothing: a copy with many changes of its own has no other shingle
    among its first and is compared with nobody. ``main`` is the token's
    commonest root, ``share`` how many rows of other roots a row of it meets,
    on average.
    """
    tokens = sets.join(loose.select("rep"), "rep").select("rep", "members").mapInArrow(_tokens, f"rep {kind}, token long")
    tokens = stored(tokens, "near-tokens")
    often = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "near-often")
    # A shingle that only one document has adds to the places before the others.
    shared = join_counted(tokens, often.withColumn("w", F.col("f")), ["token"], "w").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("t"))
    shared = shared.join(sets.select("rep", "n"), "rep").join(loose, "rep")
    places = shared.select("rep", "root", "n", F.posexplode("t").alias("k", "x"), F.size("t").alias("m"))
    places = places.select("rep", "root", "n", F.col("x.token").alias("token"), (F.col("n") - F.col("m") + F.col("k")).alias("place"))
    places = stored(places.filter(F.col("place") * 100 <= (100 - percent) * F.col("n")), "near-prefixes")

    main = stored(_shares(places, "token"), "near-main")
    # Stored, so that the joins of it with itself are of plain shuffles, whose hot keys Spark splits.
    many = stored(join_counted(places, main, ["token"], "w"), "near-many")
    discard(tokens, often, places, main)
    return many


def _shares(rows: DataFrame, key: str, turn: int | None = None) -> DataFrame:
    """(key, w, size, main, share) of the keys of ``rows(key, root, ...)`` that hold several roots; with a ``turn`` also top.

    ``w`` and ``size`` are the key's number of rows, ``main`` its commonest
    root, ``share`` how many rows of other roots one row meets, on average,
    ``top`` the member of ``main`` that the others meet in that turn.
    """
    lead = [] if turn is None else [_lead(turn)]
    each = rows.groupBy(key, "root").agg(F.count(F.lit(1)).alias("c"), *lead)
    top = [F.max_by("lead", "c").alias("top") for _ in lead]
    found = each.groupBy(key).agg(F.sum("c").alias("w"), F.sum(F.col("c").cast("double") * F.col("c")).alias("own"), F.max_by("root", "c").alias("main"), F.count(F.lit(1)).alias("roots"), *top)
    return found.filter("roots > 1").select(key, "w", F.col("w").alias("size"), "main", (F.col("w") - F.col("own") / F.col("w")).alias("share"), *["top" for _ in lead])


def _lead(turn: int) -> Column:
    """Of the members of a root in a bucket the one that is compared in ``turn``."""
    return F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("lead")


def _prefix_pairs(many: DataFrame, asking: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with a member in ``asking(rep)`` and different roots, whose prefixes meet; none that is linked is missing."""
    x = many.join(asking, "rep").select("token", "main", *[F.col(c).alias(f"x_{c}") for c in ("rep", "root", "n", "place")])
    y = many.select(F.col("token").alias("y_token"), F.col("main").alias("y_main"), *[F.col(c).alias(f"y_{c}") for c in ("rep", "root", "n", "place")])
    left = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    enough = (100 + percent) * left >= percent * (F.col("x_n") + F.col("y_n"))
    meet = (F.col("token") == F.col("y_token")) & (F.col("x_root") != F.col("y_root")) & enough
    # One of the two is of another root than the token's commonest.
    pairs = x.filter("x_root <> main").join(y, meet).union(x.filter("x_root = main").join(y.filter("y_root <> y_main"), meet))
    return pairs.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def _with_both(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...], n: int) -> DataFrame:
    """``pairs(a, b)``, a stored table of ``n`` rows, with ``columns`` of both sets as a_... and b_...."""
    if n > FEW_PAIRS:
        for key in ("b", "a"):
            pairs = pairs.join(sets.select(F.col("rep").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in columns]), key)
        return pairs
    # Sets that are in no pair stay where they are, and few rows go to few tasks.
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("rep"))
    found = sets.select("rep", *columns).join(F.broadcast(ends), "rep")
    sides = [F.first(F.when(F.col("rep") == F.col(key), F.col(c)), ignorenulls=True).alias(f"{key}_{c}") for key in ("a", "b") for c in columns]
    return found.groupBy("a", "b").agg(*sides).coalesce(1 + n // TASK_PAIRS)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """Those of the pairs (a, b), a stored table, that are linked: sizes, then signatures, then full sets.

    After the size test a partner is of about one's own size, so what is moved
    for a pair is in proportion to either document.
    """
    close = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    alike = _with_both(pairs, sets, ("n", "signature"), pairs.count()).filter(close).select("a", "b", "a_signature", "b_signature")
    alike = stored(alike.mapInArrow(_agree(agreement_floor(percent)), f"a {kind}, b {kind}"), "near-alike")
    full = _with_both(alike, sets, ("members",), alike.count()).select("a", "b", "a_members", "b_members")
    links = stored(full.mapInArrow(_confirm(percent), f"a {kind}, b {kind}"), "near-links")
    discard(alike)
    return links


def _merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named(rep, root)``, a stored table that is deleted, after the links (a, b), a stored table, between its reps."""
    ends = links.select("a", "b", F.explode(F.array("a", "b")).alias("rep"))
    if links.count() <= FEW_PAIRS:
        ends = named.join(F.broadcast(ends), "rep").coalesce(1)
    else:
        ends = named.join(ends, "rep")
    joined = components(ends.groupBy("a", "b").agg(F.min("root").alias("u"), F.max("root").alias("v")), "u", "v", few=FEW_PAIRS)
    joined = joined.withColumnsRenamed({"root": "new"})
    out = stored(named.join(joined, named["root"] == joined["node"], "left").select("rep", F.coalesce("new", "root").alias("root")), "near-named")
    discard(named)
    return out


def _pairs_of_turn(opened: DataFrame, turn: int) -> DataFrame:
    """(a, b): in each bucket of ``opened(key, rep, root, main, top)`` one member of every other root with ``top``, one of the largest root ``main``."""
    leads = opened.filter("root <> main").groupBy("key", "root").agg(_lead(turn), F.first("top").alias("top"))
    return leads.select(F.least("lead", "top").alias("a"), F.greatest("lead", "top").alias("b")).distinct()


def _pairs_within(rows: DataFrame) -> DataFrame:
    """(a, b): all members of different roots in the buckets of ``rows(key, rep, root)``."""
    x, y = (rows.select("key", F.col("rep").alias(key), F.col("root").alias(f"{key}_root")) for key in ("a", "b"))
    return x.join(y, "key").filter("a < b AND a_root <> b_root").select("a", "b").distinct()


def _several(rows: DataFrame, turn: int | None = None) -> DataFrame:
    """Those of ``rows(key, rep, root, ...)`` whose key holds several roots, with ``size``, ``main`` and ``share`` of the key, and ``top`` for a ``turn``."""
    rows = stored(rows, "near-rooted")
    mixed = stored(_shares(rows, "key", turn), "near-mixed")
    out = stored(join_counted(rows, mixed, ["key"], "w"), "near-open")
    discard(rows, mixed)
    return out


def _few_pairs(rows: DataFrame) -> bool:
    """Whether the buckets of ``rows(rep, share, ...)`` hold at most ``PAIRS`` pairs of different roots for each document."""
    pairs, reps = rows.agg(F.sum("share") / 2, F.countDistinct("rep")).first()
    return (pairs or 0) <= PAIRS * reps


def _finer(opened: DataFrame, sets: DataFrame) -> DataFrame:
    """``opened(key, band, rep, root, size, share)`` with buckets of more than ``FEW`` members cut: members that agree in four minima of one more band.

    Of two documents in one bucket that are 0.8 alike, all 31 other bands
    differ in these four with probability 8e-8, at 0.85 with 1e-10.
    """
    rows = opened.filter(F.col("size") > FEW).join(sets.select("rep", "signature"), "rep")
    finer = [F.xxhash64("key", F.lit(i), F.substring("signature", ROWS * i + 1, ROWS - 1)) for i in range(BANDS)]
    rows = rows.select("rep", "root", "band", F.posexplode(F.array(*finer)).alias("other", "key")).filter("other <> band")
    cut = _several(rows.select("key", "rep", "root"))
    columns = ("key", "rep", "root", "share")
    return opened.filter(F.col("size") <= FEW).select(*columns).union(cut.select(*columns))


def _pairs_left(opened: DataFrame, sets: DataFrame, percent: int, kind: str, exact: bool) -> DataFrame:
    """(a, b): what may still be linked among ``opened(key, band, rep, root, size, share)``, each document the cheaper way."""
    if not exact:
        finer = _finer(opened, sets)
        if _few_pairs(finer):
            return _pairs_within(finer)
    loose = stored(opened.select("rep", "root").distinct(), "near-loose")
    many = _prefixes(sets, loose, percent, kind)
    if exact:
        return _prefix_pairs(many, loose.select("rep"), percent)
    cost = many.groupBy("rep").agg(F.sum("share").alias("prefix")).join(finer.groupBy("rep").agg(F.sum("share").alias("within")), "rep", "full")
    asking = stored(cost.filter("coalesce(prefix, 0) <= coalesce(within, 0)").select("rep"), "near-asking")
    return _prefix_pairs(many, asking, percent).union(_pairs_within(finer.join(asking, "rep", "left_anti"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """One row for each row with an id: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Two
    documents are linked when ``100 * common >= percent * all`` of their
    distinct shingles of ``shingle`` words; with fewer words the whole
    sequence is the one shingle. A component's id is its smallest document id.
    With ``exact`` no bucket is cut finer: whoever shares one without a link
    goes through the prefix filter, which may compare most pairs of a large
    family whose members share much and are not linked.

    Null, empty and blank texts have no shingle and are linked with nothing.
    Rows with a null id come back with a null component and are kept; rows
    repeated with one id are one document if their texts' sets agree, and
    linked by that id if not. An empty table gives an empty result; other
    columns are not looked at. Texts of any length are taken whole. Ids must
    be whole numbers.
    """
    lean(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(base.mapInArrow(_sketches(shingle), "id long, n long, h1 long, h2 long, keys array<long>, signature binary"), "near-rows")

    full = rows.filter("n > 0 AND id IS NOT NULL")
    classes, kind = _classes(full)
    # Copies of one text are one hot key here.
    reps = stored(join_counted(full.select("id", "n", "h1", "h2"), classes.select("n", "h1", "h2", "rep", "m"), ["n", "h1", "h2"], "m").select("id", "rep"), "near-ids")
    # Repeated ids with different sets: the id links its classes.
    several = reps.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a < last").select("id", "a")
    same_id = stored(reps.join(several, "id").filter("rep > a").select("a", F.col("rep").alias("b")).distinct(), "near-same-id")

    members = classes.select("rep", F.posexplode("keys").alias("band", "key"))
    shared = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("w"), F.min("rep").alias("top")).filter("w > 1"), "near-shared")
    buckets = stored(join_counted(members, shared, ["key"], "w"), "near-buckets")

    named = stored(buckets.select("rep").distinct().withColumn("root", F.col("rep")), "near-named")
    wanted = classes.select("rep", "id", "n", "h1", "h2", "signature").join(named.select("rep"), "rep")
    texts = base.join(wanted.select("id"), "id", "left_semi")
    # Rows of a wanted id may be of several classes: a set is known by its class.
    sets = texts.mapInArrow(_sets(shingle), "n long, h1 long, h2 long, members binary").dropDuplicates(["n", "h1", "h2"])
    sets = stored(sets.join(wanted.drop("id"), ["n", "h1", "h2"]).select("rep", "n", "signature", "members"), "near-sets", "lz4")

    if not same_id.isEmpty():
        ends = same_id.select(F.col("a").alias("rep")).union(same_id.select(F.col("b").alias("rep")))
        more = stored(named.select("rep").union(ends).distinct().withColumn("root", F.col("rep")), "near-named")
        discard(named)
        named = _merged(more, same_id)
    # At first every member is a root, and one comparison for each, with the least of all its buckets, joins up most of a bucket.
    pairs = buckets.filter("rep <> top").groupBy("rep").agg(F.min("top").alias("a")).select("a", F.col("rep").alias("b"))
    opened, before, turn = buckets, math.inf, 0
    while not opened.isEmpty():
        pairs = stored(pairs, "near-pairs")
        compared = pairs.count()
        links = _confirmed(pairs, sets, percent, kind)
        found = not links.isEmpty()
        named = _merged(named, links)
        turn += 1
        spent, opened = opened, _several(opened.select("key", "band", "rep").join(named, "rep"), turn)
        discard(pairs, links, spent)
        if not found or turn == TURNS:
            break
        left, many, most = opened.agg(F.sum("share") / 2, F.countDistinct("rep"), F.max("size")).first()
        if not many or most <= FEW and left <= PAIRS * many or before - left < GAIN * compared:
            break
        before, pairs = left, _pairs_of_turn(opened, turn)
    if not opened.isEmpty():
        pairs = stored(_pairs_left(opened, sets, percent, kind, exact), "near-pairs")
        named = _merged(named, _confirmed(pairs, sets, percent, kind))
    discard(sets)

    roots = reps.join(named, "rep", "left").select("id", F.coalesce("root", "rep").cast("long").alias("root"))
    out = rows.select("id", "n").join(roots.groupBy("id").agg(F.min("root").alias("root")), "id", "left")
    out = out.withColumn("component_id", F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with its id.

    Rows repeated with one id are one document, of which one row stays, the
    one with the least text; rows without an id all stay.
    """
    gone = near_duplicates(docs, id_col, text_col, shingle, percent).filter("NOT kept").select(F.col(id_col).alias("gone")).distinct()
    left = docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
    one = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(F.col(text_col), F.lit(""))).alias("one")
    return left.filter(F.col(id_col).isNull()).union(left.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("group")).agg(one).select("one.*"))
