"""Token-id output: Parquet list columns with dictionary and delta encoding.

Documents are range-partitioned and sorted by id, encoded, and written by
Spark's Parquet writer: token ids as a dictionary-encoded list column,
document ids, lengths and offsets as delta-encoded columns, with set row group
and page sizes. Parquet's page indexes then let a reader fetch the metadata
columns alone, or the tokens of a range of documents.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, shared_dir, shuffle_parts
from .texthash import slices, tidy

#: Row group bytes, page bytes and most rows in a page of the token files.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2000
#: Runs of letters kept with their ids in each Python worker, and bytes of text encoded at once.
MEMO, CHUNK = 150_000, 2 << 20

# A word of Latin-1 letters, with ASCII punctuation behind it or nothing else in it; no apostrophe, as that starts contractions.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: itself where printable, else 256 and up in turn."""
    own = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class WordTokens:
    """Encodes texts word by word with a tokenizer that drops white space.

    Its pre-tokenizer never joins two words, so a text's ids are its words'
    ids in a row, and each distinct word of a batch is encoded once. A plain
    word is a run of letters and one of signs: Arrow cuts it, and each distinct
    run in lower case goes straight to the library's BPE model in the form its
    normaliser and pre-tokenizer give it. Every other word goes through the
    whole pipeline. Both routes are compared on probe words first.
    """

    PROBES = ("the", "Word", "École", "straße", "niño,", "über.", "***", "a!!", "x|", "THE", "|", "end).", "Ÿ", "æØ;", "")

    def __init__(self, path: str, memo: int = MEMO) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.most = memo
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self._whole(["a b\nc"])[0] != b"".join(self._whole(["a", "b", "c"])):
            raise ValueError("this tokenizer does not drop white space between words")
        self.plain = True
        self.plain = self._words(pa.array(self.PROBES))[0].tobytes() == b"".join(self._whole(list(self.PROBES)))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.int32).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, run: str) -> bytes:
        """Ids of a run of letters or of signs, kept for later batches."""
        ids = self.older.get(run)
        if ids is None:
            form = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
            ids = array("i", [t.id for t in self.whole.model.tokenize(form)]).tobytes() if form else b""
        if len(self.memo) >= self.most // 2:
            self.older, self.memo = self.memo, {}  # runs not met since the last change are forgotten
        self.memo[run] = ids
        return ids

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` in a row, and how many each has."""
        cut = pc.extract_regex(words, _PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        if not self.plain:
            plain[:] = False
        letters, signs = pc.struct_field(cut, "letters"), pc.struct_field(cut, "signs")
        runs = pa.concat_arrays([pc.utf8_lower(letters), signs]).fill_null("").dictionary_encode()
        names = runs.dictionary.to_numpy(zero_copy_only=False).tolist()  # Arrow's own to_pylist takes ten times as long
        ids = list(map(self.memo.get, names))
        for i, one in enumerate(ids):
            if one is None:
                ids[i] = self._run(names[i])
        at = runs.indices.to_numpy(zero_copy_only=False).astype(np.int32).reshape(2, -1).copy()
        rest = np.flatnonzero(~plain)
        if len(rest):
            at[0, rest] = len(ids) + np.arange(len(rest))
            at[1, rest] = len(ids) + len(rest)
            other = words.take(pa.array(rest)).to_pylist()
            for a in range(0, len(other), 4096):
                ids += self._whole(other[a : a + 4096])
            ids.append(b"")
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        return _taken(b"".join(ids), lengths, at.T.ravel()), lengths[at].sum(axis=0)

    def batch(self, text: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, and where each text's ids start (one more at the end)."""
        split = pc.ascii_split_whitespace(text.fill_null(""))
        flat = split.flatten()
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = flat.dictionary_encode()
        ids, lengths = self._words(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        if end is not None:
            ids, lengths = np.append(ids, np.int32(end)), np.append(lengths, 1)
            at = np.insert(at, bounds[1:], len(lengths) - 1)
            bounds = bounds + np.arange(len(bounds))
        totals = np.concatenate([[0], np.cumsum(lengths[at])])
        return _taken(ids, lengths, at), totals[bounds]


def _taken(ids: np.ndarray | bytes, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The groups ``at`` of ``ids``, which lie in a row with these ``lengths``."""
    ids = np.frombuffer(ids, dtype=np.int32)
    groups = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]), ids)
    return groups.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)


#: Loaded once for each worker, not for each task.
_loaded: dict[tuple[str, int], WordTokens] = {}


def _encoder(path: str, end: int, chunk: int = CHUNK, memo: int = MEMO):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _loaded.get((path, memo)) or _loaded.setdefault((path, memo), WordTokens(path, memo))
        before = row = 0
        for whole in batches:
            for a, z in slices(whole.column(1), chunk):
                b = whole.slice(a, z - a)
                ids, starts = tokens.batch(b.column(1), end)
                n = np.diff(starts)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.arange(row, row + len(b))), pa.array(before + starts[:-1]), pa.array(n), lists], ["doc_id", "shard", "row", "before", "n_tokens", "token_ids"])
                before, row = before + int(starts[-1]), row + len(b)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, chunk: int = CHUNK, memo: int = MEMO) -> None:
    """Encode every row of ``docs`` and write the token files to ``path``.

    Columns of the files: ``doc_id``, ``shard``, ``row`` (in the shard),
    ``before`` (ids before it in the shard), ``n_tokens``, ``token_ids``.
    Shards and rows ascend by id, nulls last; rows of one id stand by a hash
    of their text. Null text is empty: its only id is ``end_id``. An empty
    table writes no rows. Other columns are not written. ``chunk`` bytes of text
    are encoded at once (a longer text alone): more take less time, as a word
    is looked up once for each chunk, and more memory. Each worker keeps the
    ids of at most ``memo`` runs of letters for later chunks.
    """
    spark = docs.sparkSession
    lean(spark)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(shards or shuffle_parts(spark), *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    kind = rows.schema["doc_id"].dataType.simpleString()
    coded = rows.mapInArrow(_encoder(tokenizer_path, end_id, chunk, memo), f"doc_id {kind}, shard int, row long, before long, n_tokens long, token_ids array<int>")
    writer = coded.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.page.row.count.limit", PAGE_ROWS)
    for name in ("doc_id", "row", "before", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``shard``, ``row``: reads no tokens."""
    meta = spark.read.parquet(path).select("doc_id", "shard", "row", "before", "n_tokens")
    return _started(meta, spark, path).select("doc_id", "start", "n_tokens", "shard", "row")


def _started(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    totals = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    # One row for each shard.
    shards = totals.select("shard", F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    return rows.join(F.broadcast(shards), "shard").withColumn("start", F.col("shard_start") + F.col("before"))


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents with ``low <= doc_id <= high`` and their ids; pages outside are skipped by their index."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return _started(rows, spark, path).select("doc_id", "start", "n_tokens", "token_ids")


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        crc = [zlib.crc32(ids[ends[i] : ends[i + 1]]) for i in range(len(b))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: ``doc_id``, ``start``, ``n_tokens`` and the crc32 of the ids as little-endian 32-bit words."""
    rows = read_tokens(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_crcs, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokens_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` (to a fresh folder of the shared one unless given) and return ``token_digests``."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id, **options)
    return token_digests(spark, path)
