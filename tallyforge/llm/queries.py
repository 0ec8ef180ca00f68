"""The registered ``opN_<name>`` queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from .chat import chat_turns
from .common import load
from .decontaminate import contaminated
from .embedding_dedup import embedding_duplicates
from .exact_dedup import exact_groups
from .line_dedup import line_dedup
from .merkle import folded, leaf_of, manifest, proof_digest
from .mixing import mix
from .near_dedup import near_duplicates
from .quality import quality_scores
from .rollups import rollup_of_documents
from .spelling import variants, word_counts
from .suffix_dedup import repeated_spans
from .tokens import tokens_round_trip

from pyspark.sql import functions as F


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_of_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_turns(load(spark, sf_dir, "conversations"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens_round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_spans(load(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), shingle=3, percent=85)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and what the original proofs say of rows some of which are tampered with."""
    docs = load(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = F.when(touched, leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")]))
    rows = manifest(docs, carry={"shown": shown})
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("shown", "leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _misspelled(doc: Column, run: Column) -> Column:
    """One letter is missing where 199 divides the checksum of the document's id and the run."""
    h = F.crc32(F.concat(doc.cast("string"), F.lit(":"), run).cast("binary"))
    k = (h % F.char_length(run)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), k), F.substr(run, k + 2))).otherwise(run)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(load(spark, sf_dir, "documents"), spelled=_misspelled), ratio=5)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(load(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_rollups": op2_token_rollups,
    "op3_chat_turns": op3_chat_turns,
    "op4_decontaminate": op4_decontaminate,
    "op5_source_mixing": op5_source_mixing,
    "op6_token_ids": op6_token_ids,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_dedup": op13_embedding_dedup,
}

OP2_SQL = r"""
WITH m AS (
  SELECT doc_id, coalesce(bool_or(toxic = 1), false) AS toxic, coalesce(bool_or(quality = 0), false) AS poor FROM labels GROUP BY doc_id
), d AS (
  SELECT source, lang, coalesce(CASE WHEN NOT m.toxic AND m.poor THEN regexp_replace(text, '[^\p{L}\p{N}\x20\x09-\x0D]+', ' ', 'g') ELSE text END, '') AS text
  FROM documents LEFT JOIN m USING (doc_id) WHERE NOT coalesce(m.toxic, false)
), t AS (
  SELECT source, lang, unnest([
    {'tokenizer': 'words-1', 'n': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))},
    {'tokenizer': 'letters-2', 'n': len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]'))}]) AS x FROM d
)
SELECT source, lang, x.tokenizer AS tokenizer, count(*) AS n_docs, sum(x.n)::BIGINT AS n_tokens FROM t GROUP BY ALL
"""

OP4_SQL = r"""
WITH i AS (
  SELECT row_number() OVER (ORDER BY item_id, text) AS item, item_id, text,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+') AS w,
         regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), b AS (SELECT *, len(w) AS n FROM i WHERE len(w) > 0),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT item, unnest(w) AS term FROM b) GROUP BY term),
e AS (
  SELECT row_number() OVER () AS entry, item, slice AS w, len(slice) AS n FROM (
    SELECT item, w AS slice FROM b
    UNION ALL SELECT item, w[a + 1 : a + 64] FROM (SELECT item, w, unnest(list_append(range(0, n - 64, 32), n - 64)) AS a FROM b WHERE n > 64))
), tf AS (SELECT entry, item, n, term, count(*) AS c FROM (SELECT entry, item, n, unnest(w) AS term FROM e) GROUP BY ALL),
wt AS (
  SELECT entry, item, term, ln(1 + ((SELECT count(*) FROM b) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * c * 2.2::DOUBLE
         / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (SELECT avg(n) FROM b))) AS weight FROM tf JOIN df USING (term)
), im AS (SELECT entry, item, term, weight / sum(weight) OVER (PARTITION BY entry) AS impact FROM wt),
d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+') AS w FROM documents WHERE text IS NOT NULL
), t AS (SELECT row, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d),
p AS (SELECT DISTINCT row, pos // 64 + o AS passage, term FROM t, (VALUES (0), (1)) AS x(o) WHERE term IN (SELECT term FROM df)),
hit AS (SELECT row, passage, entry, item, sum(impact) AS score FROM p JOIN im USING (term) GROUP BY ALL HAVING sum(impact) >= 0.5::DOUBLE - 1e-9),
found AS (SELECT row, item, max(score) AS score FROM hit GROUP BY ALL),
near AS (
  SELECT DISTINCT h.row, h.item, t.pos FROM (SELECT DISTINCT row, item, passage FROM hit) h JOIN t ON t.row = h.row AND t.pos >= (h.passage - 2) * 64 AND t.pos < (h.passage + 2) * 64
), cut AS (
  SELECT item, body, contains(left(body, len(body) - 1), '?') AS asks,
         CASE WHEN contains(left(body, len(body) - 1), '?') THEN len(regexp_extract(left(body, len(body) - 1), '(?s)^.*\?'))
              WHEN regexp_matches(body, '(?s)^.*([.!][\x20\x09-\x0D]+|\n+)') THEN len(regexp_extract(body, '(?s)^.*([.!][\x20\x09-\x0D]+|\n+)')) ELSE len(body) END AS upto FROM b
), part AS (
  SELECT item, 'q' AS part, left(body, upto) AS text FROM cut UNION ALL SELECT item, 'a', substr(body, upto + 1) FROM cut UNION ALL SELECT item, 's', body FROM cut WHERE NOT asks
), pw AS (
  SELECT item, part, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+') AS w FROM part
), run AS (
  SELECT DISTINCT item, part, k, array_to_string(w[a : a + k - 1], ' ') AS run FROM (SELECT item, part, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS a FROM pw WHERE len(w) > 0)
), own AS (
  SELECT DISTINCT n.row, n.item, k, array_to_string(d.w[n.pos + 1 : n.pos + k], ' ') AS run
  FROM near n JOIN d USING (row) JOIN (SELECT DISTINCT item, k FROM run) USING (item) JOIN near z ON z.row = n.row AND z.item = n.item AND z.pos = n.pos + k - 1
  WHERE (SELECT count(*) FROM near m WHERE m.row = n.row AND m.item = n.item AND m.pos BETWEEN n.pos AND n.pos + k - 1) = k
), share AS (
  SELECT f.row, f.item, r.part, count(o.run)::DOUBLE / count(*) AS share
  FROM found f JOIN run r ON r.item = f.item LEFT JOIN own o ON o.row = f.row AND o.item = f.item AND o.k = r.k AND o.run = r.run GROUP BY ALL
), v AS (
  SELECT f.row, f.item, f.score, coalesce(max(s.share) FILTER (WHERE part = 'q'), 1) AS question_overlap, coalesce(max(s.share) FILTER (WHERE part = 'a'), 1) AS answer_overlap, max(s.share) FILTER (WHERE part = 's') AS told
  FROM found f LEFT JOIN share s USING (row, item) GROUP BY ALL
)
SELECT d.doc_id, b.item_id, round(v.score, 6) AS score, question_overlap, answer_overlap
FROM v JOIN d USING (row) JOIN b USING (item) WHERE greatest(least(question_overlap, answer_overlap), coalesce(told, 0)) >= 0.6::DOUBLE
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s)
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
     / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size, rank,
         least((SELECT max(level) FROM l WHERE level * weight <= cap) * weight, cap) AS target,
         CAST(concat('0x', substr(md5(CASE WHEN source IS NULL THEN 'mix:null' ELSE 'mix:s:' || source END), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM l
), k AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY t.rank ORDER BY d.size DESC, d.doc_id)::DOUBLE AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, greatest(0, floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT AS copies FROM k
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM c
"""

OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, md5(coalesce(text, '')) AS body, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, body, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM d),
w AS (
  SELECT doc_id, body, pos, line || chr(10) || lead(line, 1) OVER p || chr(10) || lead(line, 2) OVER p AS win
  FROM l WINDOW p AS (PARTITION BY doc_id, body ORDER BY pos)
), v AS (SELECT * FROM w WHERE win IS NOT NULL AND trim(replace(win, chr(10), ' ')) <> ''),
r AS (SELECT doc_id, body, pos, rank() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, body, pos) AS k FROM v),
x AS (SELECT DISTINCT doc_id, body, pos + o AS pos FROM r, (VALUES (0), (1), (2)) AS t(o) WHERE k > 1),
j AS (
  SELECT l.row, l.doc_id, count(*) AS n_lines, count(x.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE x.pos IS NULL), '') AS clean
  FROM l LEFT JOIN x ON l.doc_id IS NOT DISTINCT FROM x.doc_id AND l.body = x.body AND l.pos = x.pos GROUP BY l.row, l.doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(clean) AS clean_sha256 FROM j
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT row, base, h[2 * base + 1 : 2 * (base + 1199)] AS piece FROM (SELECT row, h, unnest(range(0, len(h) // 2, 1000)) AS base FROM d)),
w AS (SELECT row, base + s AS s, md5(piece[2 * s + 1 : 2 * s + 400]) AS k FROM (SELECT *, unnest(range(0, least(1000, len(piece) // 2 - 199))) AS s FROM c)),
r AS (SELECT DISTINCT row, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT row, s, sum(opens) OVER (PARTITION BY row ORDER BY s) AS span FROM (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY row ORDER BY s) + 200 THEN 0 ELSE 1 END AS opens FROM r)),
x AS (SELECT row, min(s) AS a, max(s) + 200 AS z FROM g GROUP BY row, span),
y AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 0) AS last FROM x),
t AS (
  SELECT row, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS behind, string_agg(h[2 * last + 1 : 2 * a], '' ORDER BY a) AS kept FROM y JOIN d USING (row) GROUP BY row
)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN t.row IS NULL THEN d.h ELSE t.kept || substr(d.h, 2 * behind + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (row)
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, y AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x),
m AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id, least(w.doc_id, coalesce(m.least, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: The unsigned crc32 of a list of bytes, bit by bit.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"


def _merkle_sql(levels: int = 20, groups: int = 6) -> str:
    """All levels of the trees one after the other, for up to 2^levels rows of a language and 2^groups languages."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    leaf = lambda n: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", n, "text"))) + ")"
    crc = CRC_SQL.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")
    cut = lambda a, g: f"SELECT {g} i // 2 AS i, (max(n) + 1) // 2 AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {a} GROUP BY {g} i // 2"
    climb = lambda f, a, on: (
        f"SELECT f.* EXCLUDE (i, n, shown, proof), f.i // 2 AS i, (f.n + 1) // 2 AS n, f.proof || coalesce(o.h, '') AS proof, "
        f"CASE WHEN f.n = 1 THEN f.shown WHEN o.h IS NULL THEN sha256(f.shown) WHEN f.i % 2 = 1 THEN sha256(o.h || f.shown) ELSE sha256(f.shown || o.h) END AS shown "
        f"FROM {f} f LEFT JOIN {a} o ON {on} o.i = xor(f.i, 1) AND f.n > 1"
    )
    ctes = [
        f"d AS (SELECT doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS shown FROM documents)",
        "f0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, '' AS proof FROM d)",
        "n0 AS (SELECT lang, i, n, leaf AS h FROM f0)",
        *[f"n{k + 1} AS ({cut(f'n{k}', 'lang,')})" for k in range(levels)],
        *[f"f{k + 1} AS ({climb(f'f{k}', f'n{k}', 'o.lang IS NOT DISTINCT FROM f.lang AND')})" for k in range(levels)],
        f"u0 AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM n{levels})",
        *[f"u{k + 1} AS ({cut(f'u{k}', '')})" for k in range(groups)],
        f"g0 AS (SELECT f.doc_id, f.leaf, u.h AS subroot, f.shown, f.proof, u.i, u.n FROM f{levels} f JOIN u0 u ON f.lang IS NOT DISTINCT FROM u.lang)",
        *[f"g{k + 1} AS ({climb(f'g{k}', f'u{k}', '')})" for k in range(groups)],
    ]
    return f"WITH {', '.join(ctes)} SELECT g.doc_id, g.leaf, g.subroot, u.h AS root, sha256(g.proof) AS proof_sha256, g.shown AS folded_root, g.shown = u.h AS verified FROM g{groups} g, u{groups} u"


_POINTS = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))"
OP12_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents
), h AS (SELECT run, c, {CRC_SQL.format(bytes=_POINTS)} AS h FROM (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL)),
s AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
k AS (SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM w)),
l AS (SELECT DISTINCT k.word, w.word AS other FROM k JOIN w ON w.word = k.rest),
e AS (
  SELECT a.word, b.word AS other FROM k a JOIN k b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT word, other FROM l UNION ALL SELECT other, word FROM l
), o AS (SELECT e.word, e.other, w.n AS m, row_number() OVER (PARTITION BY e.word ORDER BY w.n DESC, e.other) AS k, count(*) OVER (PARTITION BY e.word) AS n_near FROM e JOIN w ON w.word = e.other),
f AS (SELECT w.word, w.n, coalesce(o.n_near, 0) AS n_near, CASE WHEN o.m >= 5 * w.n THEN o.other END AS form, CASE WHEN o.m >= 5 * w.n THEN o.m END AS form_n FROM w LEFT JOIN o ON o.word = w.word AND o.k = 1),
t AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.next IS NULL
"""


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings
), l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS least FROM r GROUP BY x),
c AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(c.n, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept
FROM v LEFT JOIN m ON m.x = vec_id LEFT JOIN c ON c.x = vec_id
"""


ORACLE_SQL: dict[str, str] = {
    "op2_token_rollups": OP2_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_source_mixing": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_near_dedup": OP10_SQL,
    "op11_merkle_manifest": _merkle_sql(),
    "op12_spelling_variants": OP12_SQL,
    "op13_embedding_dedup": OP13_SQL,
}
