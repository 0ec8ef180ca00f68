"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of signed changes (inserts, deletes, revised counts) is summed to one
additive delta for each key, written to a folder of its own, and committed by
a marker that carries the batch id and names the folder. Markers appear whole
and never replace one another (a hard link on disks, an atomic rename on HDFS;
other stores are refused), so of two writers of one batch one wins and the
other is told so; a batch may be sent again after any failure. Totals are the
sums of all committed deltas, or of a compacted one and those since.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import files, lean, shared_dir, stored
from .texthash import slices

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, tokens long, docs long"
#: Bytes of text that a library tokenizer encodes at once.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Library:
    """A tokenizer of the tokenizers library by its vocabulary file, which every executor can read at this path."""

    path: str


#: Tokenizer versions of the query: a pattern, whose matches are tokens, or a ``Library`` for each.
TOKENIZERS: dict[str, str | Library] = {"words-1": r"[^\x20\x09-\x0D]+", "letters-2": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"}


def _library_count(path: str):
    """Counts of whole texts; the tokenizer is loaded once for each worker, not for each batch."""
    loaded: list = []

    def count(text: pa.Array) -> pa.Array:
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(path))
        out = []
        for a, b in slices(text, CHUNK):
            out += [len(e.ids) for e in loaded[0].encode_batch_fast(text.slice(a, b - a).fill_null("").to_pylist(), add_special_tokens=False)]
        return pa.array(out, pa.int64())

    count.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, "long")


def token_count(text: Column, version: str | Library) -> Column:
    """Tokens of the whole text; 0 for null."""
    if isinstance(version, Library):
        return _library_count(version.path)(text)
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(version), F.lit(0))).cast("long")


def counts(text: Column, tokenizers: dict[str, str | Library]) -> Column:
    """One count for each tokenizer version, in their order."""
    return F.array(*[token_count(text, v) for v in tokenizers.values()])


def changes(rows: DataFrame, op: Column, new: Column, old: Column, tokenizers: dict[str, str | Library]) -> DataFrame:
    """A change for each row of ``rows(source, lang, ...)`` and tokenizer version, from arrays of counts."""
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, tokenizers)).alias("tokenizer"), new.alias("n_tokens"), old.alias("old_tokens")))
    return rows.select(op.alias("op"), "source", "lang", each.alias("each")).select("op", "source", "lang", "each.*")


def delta(changes: DataFrame) -> DataFrame:
    """Sum ``changes(op, source, lang, tokenizer, n_tokens, old_tokens)`` to one row for each key.

    ``insert`` adds ``n_tokens`` and a document, ``delete`` takes them away,
    ``revise`` adds ``n_tokens - old_tokens``. Null counts are 0; a null op or
    another one changes nothing; null keys are keys; repeated rows count each;
    no rows give no rows. A document that changes its source or language is a
    delete and an insert.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).when(F.col("op") == "revise", n - old).otherwise(0)
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    return changes.groupBy(*KEYS).agg(F.sum(tokens).cast("long").alias("tokens"), F.sum(docs).cast("long").alias("docs"))


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = files(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in found if n[0] != ".")  # others are being written


def _text(spark: SparkSession, path: str) -> str:
    fs, at = files(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _link(spark: SparkSession, target, text: str) -> None:
    """On a local or mounted disk: a file written beside ``target`` gets its name by a hard link, which fails if there is one."""
    nio = spark._jvm.java.nio.file.Files
    at = spark._jvm.java.io.File(target.toUri().getPath()).toPath()
    staged = at.resolveSibling(f".{uuid.uuid4().hex}")
    nio.write(staged, bytearray(text.encode()), spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.OpenOption, 0))
    try:
        nio.createLink(at, staged)
    finally:
        nio.delete(staged)


def _rename(spark: SparkSession, fs, target, text: str) -> None:
    """On HDFS: a file written beside ``target`` is moved by a rename that never replaces, one step of its name server."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    staged = hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        never = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(staged, target, never)
    finally:
        fs.delete(staged, False)


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Make ``path`` hold ``text``, which no other writer uses; False if another writer's file is there.

    The file appears whole, in one step that fails where there is one already,
    and who has won is read from it. Stores without such a step are refused.
    """
    fs, named = files(spark, path)
    fs.mkdirs(named.getParent())
    parent = fs.resolvePath(named.getParent())
    target, fs = spark._jvm.org.apache.hadoop.fs.Path(parent, named.getName()), parent.getFileSystem(spark._jsc.hadoopConfiguration())
    kind = fs.getUri().getScheme()
    if kind not in ("file", "hdfs"):
        raise ValueError(f"a commit needs a file system with an atomic form of create, not {kind}")
    try:
        _link(spark, target, text) if kind == "file" else _rename(spark, fs, target, text)
    except Exception:
        if not fs.exists(target):
            raise
    return _text(spark, path) == text


def committed(spark: SparkSession, store: str, batch: str) -> bool:
    fs, at = files(spark, f"{store}/commits/{batch}")
    return fs.exists(at)


def commit_batch(spark: SparkSession, store: str, batch: str, changes: DataFrame) -> bool:
    """Commit a batch once; False if ``batch`` is committed already, also by a writer at the same time.

    ``batch`` names a file: no '/'. A reader sees all of a batch or nothing.
    """
    if not batch or "/" in batch or batch[0] in "._":
        raise ValueError("a batch id must be a plain file name")
    if committed(spark, store, batch):
        return False
    folder = f"{batch}-{uuid.uuid4().hex}"
    delta(changes).write.parquet(f"{store}/deltas/{folder}")
    if _claim(spark, f"{store}/commits/{batch}", folder):
        return True
    fs, at = files(spark, f"{store}/deltas/{folder}")
    fs.delete(at, True)
    return False


def _live(spark: SparkSession, store: str) -> tuple[list[str], list[str]]:
    """The folders whose sum is the totals, and the batches they hold."""
    snapshots = _names(spark, f"{store}/compacted")
    base = json.loads(_text(spark, f"{store}/compacted/{snapshots[-1]}")) if snapshots else {"folder": None, "batches": []}
    known = set(base["batches"])
    fresh = [b for b in _names(spark, f"{store}/commits") if b not in known]
    folders = [_text(spark, f"{store}/commits/{b}") for b in fresh]
    return [*([base["folder"]] if base["folder"] else []), *folders], [*base["batches"], *fresh]


def _summed(spark: SparkSession, store: str, folders: list[str]) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(*[f"{store}/deltas/{f}" for f in folders]) if folders else spark.createDataFrame([], SCHEMA)
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")


def compact(spark: SparkSession, store: str) -> bool:
    """Sum all committed deltas to one folder, which totals read from then on; False if another writer was first.

    Markers of the batches stay, so that they are refused when sent again; old
    folders stay for readers that have begun.
    """
    folders, batches = _live(spark, store)
    if len(folders) < 2:
        return False
    folder = f"compacted-{uuid.uuid4().hex}"
    _summed(spark, store, folders).select("source", "lang", "tokenizer", "tokens", "docs").write.parquet(f"{store}/deltas/{folder}")
    turn = len(_names(spark, f"{store}/compacted"))
    return _claim(spark, f"{store}/compacted/{turn:09d}", json.dumps({"folder": folder, "batches": batches}))


def totals(spark: SparkSession, store: str) -> DataFrame:
    """``source``, ``lang``, ``tokenizer``, ``n_docs``, ``n_tokens`` over all committed batches; keys at zero are left out."""
    return _summed(spark, store, _live(spark, store)[0]).select(*KEYS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def rollup_of_documents(docs: DataFrame, labels: DataFrame, tokenizers: dict[str, str | Library] = TOKENIZERS) -> DataFrame:
    """All documents inserted; then, sent twice, a batch that deletes the toxic ones and revises those of low quality.

    A revised text has its runs of symbols replaced by a space. Rows without
    an id are inserted and never changed; a document that several label rows
    name changes once; a toxic mark goes before a quality mark; rows repeated
    with one id are changed each. Null, empty and blank texts count as
    documents without tokens, texts of any length are counted whole. Empty
    tables give no rows; other columns are not looked at.

    Texts are read in one scan and never shuffled: both batches are made from
    a stored table of counts.
    """
    spark = docs.sparkSession
    lean(spark)
    store = f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"
    plain = F.regexp_replace("text", r"[^\p{L}\p{N}\x20\x09-\x0D]+", " ")
    rows = docs.select("doc_id", "source", "lang", counts(F.col("text"), tokenizers).alias("old"), counts(plain, tokenizers).alias("new"))
    rows = stored(rows, "rollup-counts")
    commit_batch(spark, store, "0001-load", changes(rows, F.lit("insert"), F.col("old"), F.col("old"), tokenizers))
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"), F.max(F.coalesce(F.col("quality") == 0, F.lit(False))).alias("poor")).filter("toxic OR poor")
    changed = rows.join(marks, "doc_id")
    clean = changes(changed, F.when(F.col("toxic"), "delete").otherwise("revise"), F.when(F.col("toxic"), F.col("old")).otherwise(F.col("new")), F.col("old"), tokenizers)
    for _ in range(2):
        commit_batch(spark, store, "0002-clean", clean)
    return totals(spark, store)
