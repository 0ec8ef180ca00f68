"""Tables as indexed arrays: vectors, matrices, points and images, and generators and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import random as R


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector(df: DataFrame, idx: str, value: str | Column) -> DataFrame:
    """``idx, v``: a vector of doubles with an explicit index."""
    value = F.col(value) if isinstance(value, str) else value
    return df.select(F.col(idx).cast("long").alias("idx"), value.cast("double").alias("v"))


def matrix(df: DataFrame, row: str, values: str) -> DataFrame:
    """``i, j, v``: one row for each cell of an array column."""
    return df.select(F.col(row).cast("long").alias("i"), F.posexplode(values).alias("j", "v")).withColumn("v", F.col("v").cast("double"))


def rows(cells: DataFrame) -> DataFrame:
    """``i, vals``: the cells of each row as one array, in order of ``j``."""
    return cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("vals"))


def points(df: DataFrame, idx: str, values: str) -> DataFrame:
    """``idx, x, y, z`` from the first three elements of an array column."""
    return df.select(F.col(idx).cast("long").alias("idx"), *[F.get(values, i).cast("double").alias(n) for i, n in enumerate("xyz")])


def iota(spark: SparkSession, n: int) -> DataFrame:
    """0 to n - 1."""
    return spark.range(n).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("v"))


def constant(spark: SparkSession, n: int, value: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(float(value)).alias("v"))


def uniform(spark: SparkSession, n: int, low: float, high: float, seed: int) -> DataFrame:
    """The same values for a seed at any partitioning, as of the two below."""
    return spark.range(n).select(F.col("id").alias("idx"), R.uniform_at(F.col("id"), seed, low, high).alias("v"))


def normal(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), R.normal_at(F.col("id"), seed).alias("v"))


def choice(spark: SparkSession, n: int, values: list[float], seed: int) -> DataFrame:
    """Each element one of ``values``, all equally likely."""
    return spark.range(n).select(F.col("id").alias("idx"), R.choice_at(F.col("id"), seed, values).alias("v"))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only on one machine where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later uses see the same rows and need none of its lineage."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
