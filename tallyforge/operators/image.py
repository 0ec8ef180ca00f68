"""Images as pixels, worked on in tiles with halos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most taps of a kernel, and the side of a tile.
MOST_TAPS, SIDE = 441, 256


def _laid(window: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """``kernel`` laid over each place of the window that has all its neighbours."""
    high, wide = window.shape[0] - kernel.shape[0] + 1, window.shape[1] - kernel.shape[1] + 1
    out = np.zeros((high, wide))
    for m, n in zip(*np.nonzero(kernel), strict=True):
        out += kernel[m, n] * window[m : m + high, n : n + wide]
    return out


def _tile(kernel: np.ndarray, rows: int, cols: int, side: int, tr: int, tc: int, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``r, c, v`` of the result in tile (tr, tc) from its pixels and those around it."""
    up, left = kernel.shape[0] // 2, kernel.shape[1] // 2
    top, first = tr * side, tc * side
    high, wide = min(side, rows - top), min(side, cols - first)
    window, there = np.zeros((2, high + 2 * up, wide + 2 * left))
    at = r - top + up, c - first + left
    inside = (at[0] < window.shape[0]) & (at[1] < window.shape[1])
    np.add.at(window, (at[0][inside], at[1][inside]), v[inside])
    there[at[0][inside], at[1][inside]] = 1
    # Pixels that nothing reaches are absent, as in the input.
    y, x = np.nonzero(_laid(there, np.ones_like(kernel)) if not there[up : up + high, left : left + wide].all() else np.ones((high, wide)))
    return y + top, x + first, _laid(window, kernel)[y, x]


def _numbered(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, null too."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _tiles(kernel: np.ndarray, rows: int, cols: int, side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # pixels of a tile of which more may come

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            tr, tc, r, c, v = (t.column(n).to_numpy() for n in ("tr", "tc", "r", "c", "v"))
            image = t.column("img")
            number = _numbered(image)
            ends = [0, *(np.flatnonzero((np.diff(tr) != 0) | (np.diff(tc) != 0) | (np.diff(number) != 0)) + 1).tolist(), len(t)]
            for a, z in zip(ends[:-1], ends[1:], strict=True):
                y, x, out = _tile(kernel, rows, cols, side, int(tr[a]), int(tc[a]), r[a:z], c[a:z], v[a:z])
                yield pa.RecordBatch.from_arrays([pa.repeat(image[a], len(y)), pa.array(y, pa.int64()), pa.array(x, pa.int64()), pa.array(out)], ["img", "r", "c", "v"])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not len(t):
                continue
            tr, tc = t.column("tr").to_numpy(), t.column("tc").to_numpy()
            number = _numbered(t.column("img"))
            same = (tr == tr[-1]) & (tc == tc[-1]) & (number == number[-1])
            cut = int(len(t) - np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from done(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and len(held):
            yield from done(held)

    return run


def correlate(pixels: DataFrame, kernel: list[list[float]], rows: int, cols: int, side: int = SIDE) -> DataFrame:
    """``img, r, c, v``: each image with ``kernel`` laid over every pixel, not flipped, zero outside; same size.

    ``pixels(img, r, c, v)``; the kernel is a small constant (odd sides, at
    most 441 taps). Pixels are dealt to tiles of ``side`` once, and again only
    where they lie in the halo of a tile beside; taps are sums of shifted
    arrays within a tile. A pixel that no pixel of the input reaches is absent;
    null values count as zero, images with a null number are an image.
    """
    high, wide = len(kernel), len(kernel[0])
    if not high % 2 or not wide % 2 or any(len(k) != wide for k in kernel) or high * wide > MOST_TAPS:
        raise ValueError("the kernel needs odd sides and at most 441 taps")
    known = pixels.select("img", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    known = known.filter(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))
    reach = lambda x, h, n: F.expr(f"sequence(greatest({x} - {h}, 0) div {side}, least({x} + {h}, {n - 1}) div {side})")
    dealt = known.withColumn("tr", F.explode(reach("r", high // 2, rows))).withColumn("tc", F.explode(reach("c", wide // 2, cols)))
    dealt = dealt.repartition("img", "tr", "tc").sortWithinPartitions("img", "tr", "tc")
    kind = pixels.schema["img"].dataType.simpleString()
    out = dealt.select("img", "tr", "tc", "r", "c", "v").mapInArrow(_tiles(np.array(kernel, dtype=float), rows, cols, side), f"img {kind}, r long, c long, v double")
    return out.select("img", F.col("r").cast(pixels.schema["r"].dataType).alias("r"), F.col("c").cast(pixels.schema["c"].dataType).alias("c"), "v")
