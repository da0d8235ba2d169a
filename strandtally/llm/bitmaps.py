"""Bitmaps of 64-bit hashes that workers test before anything is shuffled; bounded at 32 MB, and never wrong about what they hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = (20, 28)


class Bitmap:
    """Which hashes may be held; ``data`` is a broadcast."""

    def __init__(self, data, bits: int):
        self.data, self.bits = data, bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        cell = (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return np.frombuffer(self.data.value, np.uint8)[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 == 1


def bitmap_of(hashes: DataFrame, count: int, limits: tuple[int, int] = FILTER_BITS) -> Bitmap:
    """The bitmap of a column ``h`` of about ``count`` hashes: sixteen bits for each, at least and at most 2 ** limits.

    Bits are put together by Spark; words of 64 bits reach the driver, at most 2 ** 22 of them.
    """
    bits = min(limits[1], max(limits[0], (16 * count).bit_length()))
    cells = hashes.select(F.expr(f"h & {(1 << bits) - 1}").alias("cell"))
    found = cells.groupBy(F.expr("shiftright(cell, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return Bitmap(hashes.sparkSession.sparkContext.broadcast(out.tobytes()), bits)
