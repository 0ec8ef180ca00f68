"""Shared helpers: table access, lineage cuts in the shared folder, text columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of one Arrow batch of the operators that run Python.
BATCH_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, ``spark.checkpoint.dir``.

    Where the session names none, a local folder is made on one machine
    (tests); on a cluster that is an error. All tables of a run lie in its
    folder, so it can be deleted as a whole when the run's results are read.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/tallyforge-{sc.applicationId}"


def files(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and its Hadoop path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def lean(spark: SparkSession) -> None:
    """From now on this session hands texts to Python in batches of a few MB, where it does not ask for smaller ones.

    Spark's default of 64 MB is held several times over, in the executor and in each of its workers.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"(\d+)b?$", spark.conf.get(key))
    if now and int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    This cuts the lineage: what follows survives a lost executor without
    computing ``df`` again, and two uses of it see the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared folder, with its partitions and their order, which ``stored`` does not keep."""
    sc, at = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return df.checkpoint()


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing that is still to be computed reads it."""
    for t in tables:
        fs, at = files(t.sparkSession, t.stored_at)
        fs.delete(at, True)


@contextmanager
def range_samples(spark: SparkSession, n: int) -> Iterator[None]:
    """Inside, Spark samples ``n`` keys for each range instead of 100; for long keys, all of which pass through the driver."""
    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and as ``weight`` how many rows of ``left`` have it.

    A key with more than a quarter of a task's fair share of the rows would
    make one task slow. Such keys are four for each task at most, whatever the
    data: their hashes come to the driver, and rows with one of these hashes
    are joined by broadcast, where they lie. All others are shuffled by key. A
    row passes one join, and where no key is hot there is only the shuffle.
    ``right`` should be a stored table, as it is read several times; keys are
    not null, and of the same types on both sides. ``weight`` is not in the
    result.
    """
    if left.select(*keys).dtypes != right.select(*keys).dtypes:
        raise ValueError("the keys must have the same types on both sides, as their hashes are compared")
    total = right.agg(F.sum(weight)).first()[0] or 0
    bar = max(1, total // (4 * shuffle_parts(left.sparkSession)))
    code = f"xxhash64({', '.join(f'`{k}`' for k in keys)})"
    hot = [r[0] for r in right.filter(F.col(weight) > bar).select(F.expr(code)).distinct().collect()]
    right = right.drop(weight)
    if not hot:
        return left.join(right, keys)
    # As text, since each item of isin() would be a call to the JVM.
    often = F.expr(f"{code} IN ({', '.join(f'{h}L' for h in hot)})")
    lying = left.filter(often).join(F.broadcast(right.filter(often)), keys)
    return lying.unionByName(left.filter(~often).join(right.filter(~often), keys))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blanks_to_space(text: Column) -> Column:
    """Null to empty; tab, LF, VT, FF and CR to a space each (byte-level replaces)."""
    out = F.coalesce(text, F.lit(""))
    for ch in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(ch), F.lit(" "))
    return out


def squashed(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add ``into``: ``text`` with every run of ASCII white space as one space."""
    df = df.withColumn(into, blanks_to_space(F.col(text)))
    once = F.col(into)
    return df.withColumn(into, F.when(once.contains("  "), F.regexp_replace(once, " +", " ")).otherwise(once))


def word_count(text: Column) -> Column:
    """How many maximal runs of bytes other than ASCII white space; 0 for null."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
