"""Normalisation and gated activations over cells ``i, j, v``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import gelu
from .reduce import column_moments, row_softmax_terms


def softmax(cells: DataFrame) -> DataFrame:
    """Over each row, shifted by its maximum."""
    return cells.join(row_softmax_terms(cells), "i").select("i", "j", (F.exp(F.col("v") - F.col("top")) / F.col("total")).alias("v"))


def batch_norm(cells: DataFrame, params: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Over each column ``j``, with the batch's own mean and population variance. ``params(j, gamma, beta)``.

    Moments are partial sums of one row for each column and task; no column is
    gathered, however many rows it has.
    """
    stats = column_moments(cells).join(params, "j")
    scaled = (F.col("v") - F.col("mean")) / F.sqrt(F.col("variance") + eps)
    return cells.join(stats, "j").select("i", "j", (F.col("gamma") * scaled + F.col("beta")).alias("v"))


def geglu(cells: DataFrame, width: int) -> DataFrame:
    """``v[j] * gelu(v[j + width div 2])`` for the first half of each row; an odd last element is dropped."""
    half = width // 2
    gates = cells.filter((F.col("j") >= half) & (F.col("j") < 2 * half)).select("i", (F.col("j") - half).alias("j"), gelu(F.col("v")).alias("gate"))
    return cells.filter(F.col("j") < half).join(gates, ["i", "j"]).select("i", "j", (F.col("v") * F.col("gate")).alias("v"))
