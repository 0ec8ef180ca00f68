"""Registered queries of the numeric operators over the given tables, each with an SQL oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import random as R
from ..functions import scalar as S
from ..operators import image, linalg, neighbors, neural, order, reduce, scan, tiles
from ..operators.attention import attention_rows
from ..sources import ingress
from ..streaming.topk import StreamingTopK
from ..streaming.windows import drained, windowed_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with its oracle."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a matrix: rows are vectors."""
    return ingress.matrix(ingress.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values as a vector."""
    return ingress.vector(ingress.table(spark, sf_dir, "events"), "event_id", "value")


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingress.table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.round(F.col("value") * 100).cast("long").alias("v"))


def weights(spark: SparkSession, n: int) -> DataFrame:
    """A made-up n by n matrix: (3i + 5j) mod 7 - 3."""
    r = spark.range(n)
    return r.select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).select("i", "j", ((F.col("i") * 3 + F.col("j") * 5) % 7 - 3).cast("double").alias("v"))


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


E_SQL = "e AS (SELECT vec_id AS i, (generate_subscripts(embedding, 1) - 1)::INT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
W_SQL = "w AS (SELECT i.range AS i, j.range AS j, ((i.range * 3 + j.range * 5) % 7 - 3)::DOUBLE AS v FROM range(64) i, range(64) j)"
CENTS_SQL = "c AS (SELECT event_id AS idx, round(value * 100)::BIGINT AS v FROM events)"
ERF_SQL = "CASE WHEN abs({z}) >= 4 THEN sign({z}) ELSE 1.1283791670955126 * list_sum(list_transform(range(0, 60), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp(CASE WHEN {z} = 0 THEN -700 ELSE (2 * n + 1) * ln(abs({z})) END - lgamma(n + 1)) / (2 * n + 1))) * sign({z}) END"


def _hashed(idx: str, table: str, seed: int = 7) -> str:
    """``h(idx, u0, u1)``: the numbers of ``random.unit_at`` for two streams, by xxHash64 in 128-bit arithmetic."""
    # The primes of xxHash64.
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    full = 1 << 64

    def turned(x: int, n: int) -> int:
        return ((x << n) | (x >> (64 - n))) % full

    def hashed(x: int, start: int) -> int:
        h = turned((start + p5 + 8) % full ^ (turned(x * p2 % full, 31) * p1 % full), 27) * p1 + p4
        h %= full
        h = (h ^ (h >> 33)) * p2 % full
        h = (h ^ (h >> 29)) * p3 % full
        return h ^ (h >> 32)

    big = lambda n: f"{n}::UHUGEINT"
    turn = lambda x, n: f"(({x} % {big(1 << (64 - n))}) * {big(1 << n)} + {x} // {big(1 << (64 - n))})"
    times = lambda x, p: f"(({x} * {big(p)}) % {big(full)})"
    parts = []
    for k in (0, 1):
        start = (hashed(k, hashed(seed, 42)) + p5 + 8) % full
        parts += [
            f"a{k} AS (SELECT {idx} AS idx, {times(f'{idx}::UHUGEINT', p2)} AS x FROM {table})",
            f"b{k} AS (SELECT idx, xor({times(turn('x', 31), p1)}, {big(start)}) AS x FROM a{k})",
            f"c{k} AS (SELECT idx, ({times(turn('x', 27), p1)} + {big(p4)}) % {big(full)} AS x FROM b{k})",
            f"d{k} AS (SELECT idx, {times(f'xor(x, x // {big(1 << 33)})', p2)} AS x FROM c{k})",
            f"e{k} AS (SELECT idx, {times(f'xor(x, x // {big(1 << 29)})', p3)} AS x FROM d{k})",
            f"g{k} AS (SELECT idx, ((xor(x, x // {big(1 << 32)}) // {big(1 << 12)})::DOUBLE + 0.5::DOUBLE) * pow(2::DOUBLE, -52) AS u FROM e{k})",
        ]
    return f"WITH {', '.join(parts)}, h AS (SELECT idx, g0.u AS u0, g1.u AS u1 FROM g0 JOIN g1 USING (idx))"


# Reductions


@query("SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
def reduction_sum(spark, sf_dir):
    return reduce.total(ingress.table(spark, sf_dir, "lineitem"), F.col("l_extendedprice")).select(F.round("total", 2).alias("total"))


@query(f"WITH {CENTS_SQL} SELECT idx // 1024 AS block, sum(v)::BIGINT AS total FROM c GROUP BY ALL")
def block_sum(spark, sf_dir):
    return reduce.block_sum(cents(spark, sf_dir))


@query(f"WITH {CENTS_SQL} SELECT sum(v)::BIGINT AS total FROM c WHERE idx BETWEEN 100 AND 899")
def subarray_sum(spark, sf_dir):
    return reduce.subarray_sum(cents(spark, sf_dir), 100, 899)


@query("SELECT 0::BIGINT AS total")
def subarray_sum_empty(spark, sf_dir):
    return reduce.subarray_sum(cents(spark, sf_dir), 899, 100)


@query(f"WITH {E_SQL} SELECT sum(floor(v * 1000))::BIGINT AS total FROM e WHERE i BETWEEN 10 AND 99 AND j BETWEEN 3 AND 40")
def subarray_sum_2d(spark, sf_dir):
    quantised = cells(spark, sf_dir).withColumn("v", F.floor(F.col("v") * 1000).cast("long"))
    return reduce.subarray_sum_2d(quantised, (10, 99), (3, 40))


@query(f"WITH {E_SQL} SELECT count(*) FILTER (WHERE floor(v * 10) = 0) AS n FROM e")
def count_equal(spark, sf_dir):
    tensor = cells(spark, sf_dir).select("i", F.expr("j div 8").alias("j"), (F.col("j") % 8).alias("k"), F.floor(F.col("v") * 10).cast("int").alias("v"))
    return reduce.count_equal(tensor, F.col("v"), 0)


@query("SELECT r.range::INT AS bin, count(p_size) AS cnt FROM range(60) r LEFT JOIN part ON p_size = r.range GROUP BY r.range")
def histogram(spark, sf_dir):
    return reduce.histogram(ingress.table(spark, sf_dir, "part"), F.col("p_size"), 60)


@query(f"WITH {CENTS_SQL} SELECT ((abs(v) >> 8) & 255)::INT AS bin, count(*) AS cnt FROM c GROUP BY ALL")
def radix_histogram(spark, sf_dir):
    return reduce.radix_histogram(cents(spark, sf_dir).select(F.abs("v").alias("key")), "key", 8)


@query(f"WITH {CENTS_SQL} SELECT (abs(v) & 255)::INT AS bin, count(*) AS cnt FROM c WHERE (abs(v) & 3840) = 512 GROUP BY ALL")
def radix_histogram_masked(spark, sf_dir):
    return reduce.radix_histogram(cents(spark, sf_dir).select(F.abs("v").alias("key")), "key", 0, mask=3840, prefix=512)


@query("SELECT round(sum(l_quantity * l_extendedprice), 0) AS dot FROM lineitem")
def dot_product(spark, sf_dir):
    return reduce.dot(ingress.table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice")).select(F.round("dot", 0).alias("dot"))


@query("SELECT round(sum(e.value::DOUBLE * p.p_retailprice), 2) AS dot FROM events e JOIN part p ON e.event_id = p.p_partkey")
def dot_vectors(spark, sf_dir):
    b = ingress.vector(ingress.table(spark, sf_dir, "part"), "p_partkey", "p_retailprice")
    return reduce.dot_vectors(values(spark, sf_dir), b).select(F.round("dot", 2).alias("dot"))


@query("SELECT round(avg((p_retailprice * l_quantity - l_extendedprice) * (p_retailprice * l_quantity - l_extendedprice)), 0) AS mse FROM lineitem JOIN part ON l_partkey = p_partkey")
def mse(spark, sf_dir):
    both = ingress.table(spark, sf_dir, "lineitem").join(ingress.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return reduce.mean_squared_error(both, F.col("p_retailprice") * F.col("l_quantity"), F.col("l_extendedprice")).select(F.round("mse", 0).alias("mse"))


@query("""
WITH x AS (SELECT label, list_transform(embedding[1:10], lambda z: z::DOUBLE) AS z FROM embeddings),
y AS (SELECT label, z, list_max(z) AS m FROM x)
SELECT round(avg(ln(list_sum(list_transform(z, lambda a: exp(a - m)))) + m - z[label + 1]), 6) AS loss FROM y""")
def cross_entropy(spark, sf_dir):
    rows = ingress.table(spark, sf_dir, "embeddings").select("label", F.transform(F.slice("embedding", 1, 10), lambda z: z.cast("double")).alias("z"))
    return reduce.cross_entropy(rows, F.col("z"), F.col("label")).select(F.round("loss", 6).alias("loss"))


@query(f"""
WITH {E_SQL}, m AS (SELECT i, max(v) AS top FROM e GROUP BY i), s AS (SELECT i, any_value(top) AS top, ln(sum(exp(v * 9 - top * 9))) AS total FROM e JOIN m USING (i) GROUP BY i)
SELECT round(avg(total + top * 9 - v * 9), 6) AS loss FROM s JOIN embeddings ON vec_id = s.i JOIN e ON e.i = s.i AND e.j = label""")
def cross_entropy_cells(spark, sf_dir):
    """All 64 numbers of an embedding, times nine, as logits."""
    labels = ingress.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), "label")
    return reduce.cross_entropy_cells(cells(spark, sf_dir).withColumn("v", F.col("v") * 9.0), labels).select(F.round("loss", 6).alias("loss"))


@query(f"WITH {E_SQL} SELECT j, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v), 6) + 0.0 AS variance FROM e GROUP BY j")
def column_moments(spark, sf_dir):
    return reduce.column_moments(cells(spark, sf_dir)).select("j", rounded("mean").alias("mean"), rounded("variance").alias("variance"))


@query(f"WITH {E_SQL}, m AS (SELECT i, max(v) AS top FROM e GROUP BY i) SELECT i, round(any_value(top), 6) + 0.0 AS top, round(sum(exp(v - top)), 6) AS total FROM e JOIN m USING (i) GROUP BY i")
def row_max_sum_exp(spark, sf_dir):
    return reduce.row_softmax_terms(cells(spark, sf_dir)).select("i", rounded("top").alias("top"), F.round("total", 6).alias("total"))


@query(f"WITH {E_SQL} SELECT i, arg_min(j, {{'v': v, 'j': j}}) AS j FROM e GROUP BY i")
def argmin(spark, sf_dir):
    return reduce.argmin_rows(cells(spark, sf_dir))


@query("SELECT round(max(abs(e.value - p.p_retailprice)), 6) AS most, round(max(abs(p.p_retailprice)), 6) AS scale FROM events e JOIN part p ON e.event_id = p.p_partkey")
def max_abs_diff(spark, sf_dir):
    b = ingress.vector(ingress.table(spark, sf_dir, "part"), "p_partkey", "p_retailprice")
    return reduce.max_difference(values(spark, sf_dir), b).select(F.round("most", 6).alias("most"), F.round("scale", 6).alias("scale"))


# Scans


@query(f"WITH {CENTS_SQL} SELECT idx, (sum(v) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM c")
def prefix_sum_inclusive(spark, sf_dir):
    return scan.prefix_sum(cents(spark, sf_dir))


@query(f"WITH {CENTS_SQL} SELECT idx, coalesce(sum(v) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS total FROM c")
def prefix_sum_exclusive(spark, sf_dir):
    return scan.prefix_sum(cents(spark, sf_dir), inclusive=False)


@query(f"WITH {CENTS_SQL} SELECT idx, coalesce(sum(v) OVER (PARTITION BY idx // 1024 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS total FROM c")
def prefix_sum_block(spark, sf_dir):
    return scan.block_prefix_sum(cents(spark, sf_dir))


@query("SELECT r.range::INT AS bin, count(p_size) AS cnt, (sum(count(p_size)) OVER (ORDER BY r.range DESC))::BIGINT AS at_least FROM range(60) r LEFT JOIN part ON p_size = r.range GROUP BY r.range")
def suffix_sum(spark, sf_dir):
    return scan.suffix_counts(histogram(spark, sf_dir))


@query("""
WITH h AS (SELECT p_size AS bin, count(*) AS cnt FROM part GROUP BY ALL), s AS (SELECT bin, cnt, sum(cnt) OVER (ORDER BY bin DESC) AS at_least FROM h)
SELECT bin, (at_least - cnt)::BIGINT AS above FROM s WHERE at_least >= 100 ORDER BY bin DESC LIMIT 1""")
def rank_in_histogram(spark, sf_dir):
    return scan.rank_in_histogram(histogram(spark, sf_dir), 100)


# Sorting and selection


@query("SELECT event_id AS idx, value::DOUBLE AS v, row_number() OVER (ORDER BY value, event_id) AS rank FROM events")
def sort_rank(spark, sf_dir):
    return order.sorted_ranks(values(spark, sf_dir))


@query("SELECT event_id AS idx, value::DOUBLE AS v, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events")
def sort_rank_desc(spark, sf_dir):
    return order.sorted_ranks(values(spark, sf_dir), descending=True)


@query("SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 100")
def topk_values(spark, sf_dir):
    return order.topk(ingress.table(spark, sf_dir, "lineitem"), "l_extendedprice", 100)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def topk_pairs(spark, sf_dir):
    return order.topk(ingress.table(spark, sf_dir, "events"), "value", 100, "event_id")


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 100")
def topk_min(spark, sf_dir):
    return order.topk(ingress.table(spark, sf_dir, "events"), "value", 100, "event_id", largest=False)


@query("SELECT event_type, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INT AS rank FROM events QUALIFY rank <= 5")
def topk_grouped(spark, sf_dir):
    return order.topk_grouped(ingress.table(spark, sf_dir, "events"), "event_type", "value", 5, "event_id")


@query("SELECT value AS kth FROM events ORDER BY value DESC LIMIT 1 OFFSET 49")
def kth_largest(spark, sf_dir):
    return order.kth_largest(ingress.table(spark, sf_dir, "events"), "value", 50)


@query("WITH k AS (SELECT value AS kth FROM events ORDER BY value DESC LIMIT 1 OFFSET 49) SELECT kth, (SELECT count(*) FROM events, k WHERE value > kth) AS n FROM k")
def survivor_count(spark, sf_dir):
    return order.survivors(ingress.table(spark, sf_dir, "events"), "value", 50)


@query("SELECT event_id AS idx, value::DOUBLE AS v FROM events WHERE value > 100")
def threshold_select(spark, sf_dir):
    return values(spark, sf_dir).filter(F.col("v") > 100)


@query("SELECT event_id AS idx, value::DOUBLE AS v FROM events WHERE event_id % 97 = 0")
def strided_sample(spark, sf_dir):
    return order.strided(values(spark, sf_dir), 97)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def streaming_topk(spark, sf_dir):
    """The events as a stream of files, merged batch by batch into k rows."""
    source = ingress.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]").select("event_id", "value")
    return StreamingTopK(spark, f"{ingress.shared_dir(spark)}/topk-{uuid.uuid4().hex}", "value", 100, "event_id").run(stream)


@query("""
WITH r AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS rank, count(*) OVER () AS n FROM events)
SELECT x.rank, r.value FROM (SELECT unnest([1, 50, 10000, count(*) // 2, count(*)]) AS rank FROM events) x JOIN r ON r.rank = least(x.rank, r.n)""")
def order_statistics(spark, sf_dir):
    """Several ranks at once, the median and the least among them; beyond the last one it is the last."""
    events = ingress.table(spark, sf_dir, "events")
    n = events.count()
    return order.order_statistics(events, "value", [1, 50, 10000, n // 2, n])


@query("SELECT event_id, value FROM events QUALIFY row_number() OVER (ORDER BY value DESC, event_id) <= (SELECT count(*) // 2 FROM events)")
def topk_half(spark, sf_dir):
    """The larger half of all rows."""
    events = ingress.table(spark, sf_dir, "events")
    return order.topk(events, "value", events.count() // 2, "event_id")


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id AS idx, value::DOUBLE AS v FROM events WHERE event_id IN (SELECT i.range * n // 137 FROM range(137) i, n)")
def strided_exactly(spark, sf_dir):
    v = values(spark, sf_dir)
    return order.strided_exactly(v, v.count(), 137)


@query("""
WITH e AS (SELECT event_type AS key, epoch(ts)::BIGINT // 86400 * 86400 AS start, value, event_id AS tie, max(epoch(ts)::BIGINT) OVER () AS seen FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
SELECT coalesce(key, '') AS key, start, row_number() OVER (PARTITION BY key, start ORDER BY value DESC, tie)::INT AS rank, value::DOUBLE AS value, tie FROM e WHERE start + 86400 < seen - 3600 QUALIFY rank <= 3""")
def streaming_windows(spark, sf_dir):
    """The three largest values of each type of event and day, as days close behind the watermark."""
    source = ingress.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]")
    rows = windowed_topk(stream, "event_type", "ts", "value", "event_id", 3, 86400, 3600)
    return drained(spark, rows, f"{ingress.shared_dir(spark)}/windows-{uuid.uuid4().hex}")


# Random numbers by counter


@query(f"{_hashed('event_id', 'events')} SELECT idx, round(v + (u0 * 2 - 1), 6) + 0.0 AS v FROM (SELECT event_id AS idx, value::DOUBLE AS v FROM events) JOIN h USING (idx)")
def uniform_noise(spark, sf_dir):
    """The events' values with noise from -1 to 1, the same for each event however the table lies."""
    return values(spark, sf_dir).select("idx", rounded(F.col("v") + R.uniform_at(F.col("idx"), 7, -1.0, 1.0)).alias("v"))


@query(f"{_hashed('event_id', 'events')} SELECT idx, round(v + sqrt(-2 * ln(u0)) * cos(u1 * 2 * pi()), 6) + 0.0 AS v FROM (SELECT event_id AS idx, value::DOUBLE AS v FROM events) JOIN h USING (idx)")
def normal_noise(spark, sf_dir):
    return values(spark, sf_dir).select("idx", rounded(F.col("v") + R.normal_at(F.col("idx"), 7)).alias("v"))


@query(f"{_hashed('event_id', 'events')} SELECT [1.0, 2.5, 7.0][floor(u0 * 3)::INT + 1]::DOUBLE AS arm, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events JOIN h ON idx = event_id GROUP BY ALL")
def choice_arms(spark, sf_dir):
    """Events dealt to three arms at random, and what each has."""
    return cents(spark, sf_dir).withColumn("arm", R.choice_at(F.col("idx"), 7, [1.0, 2.5, 7.0])).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


# Element-wise


def _mapped(name: str, make: Callable[[Column], Column], sql: str) -> None:
    def run(spark, sf_dir):
        return cells(spark, sf_dir).select("i", "j", rounded(make(F.col("v"))).alias("v"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {E_SQL} SELECT i, j, round({sql}, 6) + 0.0 AS v FROM e"


_mapped("relu", S.relu, "greatest(v, 0)")
_mapped("leaky_relu", S.leaky_relu, "CASE WHEN v <= 0 THEN 0.01 * v ELSE v END")
_mapped("leaky_relu_split", S.leaky_relu_split, "greatest(v, 0) + 0.01 * least(v, 0)")
_mapped("sigmoid", S.sigmoid, "1 / (1 + exp(-v))")
_mapped("clip", lambda x: S.clip(x, -0.1, 0.1), "least(greatest(v, -0.1), 0.1)")
_mapped("gelu", S.gelu, "0.5 * v * (1 + " + ERF_SQL.format(z="(v * 0.7071067811865476)") + ")")


@query(f"WITH {E_SQL} SELECT a.i, a.j, round(a.v * 0.5 * b.v * (1 + " + ERF_SQL.format(z="(b.v * 0.7071067811865476)") + "), 6) + 0.0 AS v FROM e a JOIN e b ON a.i = b.i AND b.j = a.j + 32 WHERE a.j < 32")
def geglu(spark, sf_dir):
    return neural.geglu(cells(spark, sf_dir), 64).select("i", "j", rounded("v").alias("v"))


@query(f"WITH {E_SQL} SELECT i, j // 3 AS pix, round(sum(v * CASE j % 3 WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END), 6) + 0.0 AS gray FROM e WHERE j < 63 GROUP BY ALL")
def rgb_to_grayscale(spark, sf_dir):
    pixels = ingress.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda p: F.struct(*[F.get("embedding", p * 3 + c).cast("double").alias(n) for c, n in enumerate("rgb")]))).alias("pix", "p"))
    return pixels.select("i", "pix", rounded(S.grayscale(F.col("p.r"), F.col("p.g"), F.col("p.b"))).alias("gray"))


@query("""
WITH k AS (SELECT event_id AS idx, value::FLOAT AS f FROM events), b AS (SELECT idx, f, dense_rank() OVER (ORDER BY f) AS r FROM k)
SELECT idx, r AS rank FROM b""")
def float_order_key(spark, sf_dir):
    keyed = values(spark, sf_dir).select("idx", S.float_order_key(F.col("v")).alias("key"))
    # The key's order is the value's: places among the distinct keys.
    places = order.sorted_ranks(keyed.select(F.col("key").alias("v")).distinct().withColumn("idx", F.lit(0)))
    return keyed.join(places.select(F.col("v").alias("key"), F.col("rank")), "key").select("idx", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey AS idx, ((p_size + 7 - 1) // 7)::BIGINT AS blocks, (2 ^ ceil(log2(p_size)))::BIGINT AS padded FROM part")
def block_shapes(spark, sf_dir):
    """Blocks of seven that a size needs, and the power of two it is padded to."""
    part = ingress.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("idx"), S.ceil_div(F.col("p_size"), F.lit(7)).alias("blocks"), S.next_pow2(F.col("p_size")).alias("padded"))


@query("SELECT event_id AS idx, event_id::DOUBLE AS v, value > event_id AS above FROM events")
def iota(spark, sf_dir):
    """As many whole numbers as there are events, held against the events' values."""
    v = values(spark, sf_dir).withColumnRenamed("v", "value")
    return ingress.iota(spark, v.count()).join(v, "idx").select("idx", "v", (F.col("value") > F.col("v")).alias("above"))


# Matrices


@query(f"WITH {E_SQL} SELECT j AS i, i AS j, v FROM e")
def transpose(spark, sf_dir):
    return linalg.transpose(cells(spark, sf_dir))


@query(f"WITH {E_SQL} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM e a JOIN e b ON a.i = b.i GROUP BY ALL")
def matmul(spark, sf_dir):
    """The product of the embeddings' transpose and the embeddings."""
    e = tiles.row_tiles(ingress.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    product = tiles.cells_of(tiles.multiply(tiles.transposed(e), e))
    return product.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), rounded("v", 5).alias("v"))


@query(f"WITH {E_SQL}, {W_SQL}, p AS (SELECT e.i, w.j, sum(e.v * w.v) AS v FROM e JOIN w ON e.j = w.i GROUP BY ALL) SELECT p.i, p.j::INT AS j, round(1.5 * p.v + 0.5 * e.v, 5) + 0.0 AS v FROM p JOIN e ON p.i = e.i AND p.j = e.j")
def gemm_alpha_beta(spark, sf_dir):
    e = cells(spark, sf_dir)
    return linalg.gemm(e, weights(spark, 64), e, 1.5, 0.5).select("i", "j", rounded("v", 5).alias("v"))


@query(f"WITH {E_SQL} SELECT v.vec_id AS i, round(coalesce(sum(e.v * (e.j + 1)), 0), 5) + 0.0 AS y FROM embeddings v LEFT JOIN e ON e.i = v.vec_id AND abs(e.v) >= 0.2 GROUP BY ALL")
def spmv(spark, sf_dir):
    e = cells(spark, sf_dir)
    sparse = e.withColumn("v", F.when(F.abs("v") < 0.2, 0.0).otherwise(F.col("v")))
    x = spark.range(64).select(F.col("id").cast("int").alias("j"), (F.col("id") + 1).cast("double").alias("x"))
    rows = ingress.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"))
    return linalg.spmv(sparse, x, rows).select("i", rounded("y", 5).alias("y"))


@query(f"WITH {E_SQL} SELECT i, j, round(v + v * v, 6) + 0.0 AS v FROM e")
def matrix_add(spark, sf_dir):
    e = cells(spark, sf_dir)
    return linalg.matrix_add(e, e.withColumn("v", F.col("v") * F.col("v"))).select("i", "j", rounded("v").alias("v"))


@query("SELECT 2 * event_id AS idx, value::DOUBLE AS v FROM events UNION ALL SELECT 2 * event_id + 1, value::DOUBLE * 2 FROM events")
def interleave(spark, sf_dir):
    v = values(spark, sf_dir)
    return linalg.interleave(v, v.withColumn("v", F.col("v") * 2))


@query(f"WITH {E_SQL}, m AS (SELECT j, avg(v) AS m, var_pop(v) AS s FROM e GROUP BY j) SELECT i, e.j, round((1 + e.j / 64.0::DOUBLE) * (v - m) / sqrt(s + 1e-5) + e.j / 100.0::DOUBLE, 5) + 0.0 AS v FROM e JOIN m ON e.j = m.j")
def batch_norm(spark, sf_dir):
    params = spark.range(64).select(F.col("id").cast("int").alias("j"), (F.lit(1.0) + F.col("id") / 64.0).alias("gamma"), (F.col("id") / 100.0).alias("beta"))
    return neural.batch_norm(cells(spark, sf_dir), params).select("i", "j", rounded("v", 5).alias("v"))


@query(f"WITH {E_SQL}, m AS (SELECT i, max(v) AS m FROM e GROUP BY i), s AS (SELECT i, m, sum(exp(v - m)) AS s FROM e JOIN m USING (i) GROUP BY ALL) SELECT e.i, j, round(exp(v - m) / s, 6) AS v FROM e JOIN s ON e.i = s.i")
def softmax(spark, sf_dir):
    return neural.softmax(cells(spark, sf_dir)).select("i", "j", F.round("v", 6).alias("v"))


@query(f"""
WITH {E_SQL}, p AS (SELECT q.i, k.i AS j, sum(q.v * k.v) / 8.0 AS s FROM e q JOIN e k ON q.j = k.j WHERE q.i % 20 = 0 GROUP BY ALL),
t AS (SELECT i, max(s) AS top FROM p GROUP BY i), w AS (SELECT p.i, j, exp(s - top) AS w FROM p JOIN t ON p.i = t.i),
n AS (SELECT i, sum(w) AS n FROM w GROUP BY i), o AS (SELECT w.i, e.j, sum(w.w * e.v) AS v FROM w JOIN e ON w.j = e.i GROUP BY ALL)
SELECT o.i, j, round(v / n, 6) + 0.0 AS v FROM o JOIN n ON o.i = n.i""")
def attention(spark, sf_dir):
    """Every twentieth embedding asks all of them."""
    e = ingress.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("k"))
    out = attention_rows(e.filter("i % 20 = 0").withColumnRenamed("k", "q"), e.withColumn("v", F.col("k")), 64)
    return out.select("i", F.posexplode("vals").alias("j", "v")).select("i", "j", rounded("v").alias("v"))


@query("""
WITH p AS (SELECT vec_id AS idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT a.idx, arg_min(b.idx, {'d': (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 'i': b.idx}) AS nn FROM p a JOIN p b ON a.idx <> b.idx GROUP BY a.idx""")
def nearest_neighbour(spark, sf_dir):
    return neighbors.nearest_neighbour(ingress.points(ingress.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


@query(f"""
WITH {E_SQL}, k AS (SELECT m.range - 1 AS dr, n.range - 1 AS dc, (CASE WHEN m.range = 1 THEN 2 ELSE 1 END) * (CASE WHEN n.range = 1 THEN 2 ELSE 1 END) / 16.0::DOUBLE AS w FROM range(3) m, range(3) n),
s AS (SELECT i AS img, (j // 8) - dr AS r, (j % 8) - dc AS c, v * w AS v FROM e, k)
SELECT img, r::INT AS r, c::INT AS c, round(sum(v), 6) + 0.0 AS v FROM s WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 GROUP BY ALL""")
def gaussian_blur(spark, sf_dir):
    pixels = cells(spark, sf_dir).select(F.col("i").alias("img"), F.expr("j div 8").cast("int").alias("r"), (F.col("j") % 8).alias("c"), "v")
    kernel = [[w / 16 for w in row] for row in ((1, 2, 1), (2, 4, 2), (1, 2, 1))]
    return image.correlate(pixels, kernel, 8, 8).select("img", "r", "c", rounded("v").alias("v"))
