"""A set of slots as a bitmap of fixed size: what is in the set always passes, and little else."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slot_bits(slots: DataFrame, size: int) -> bytes:
    """Bit s of the result (lowest bit of a byte first) is set for each ``slot`` s of the rows.

    The bitmap is built by executors in parts of 4 KB; size / 8 bytes reach the driver at most,
    whatever the number of rows.
    """
    at = F.col("slot") + 1  # positions count from 1
    parts = slots.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = bytearray(max(size, 1 << 15) // 8)
    for row in parts.toLocalIterator():
        start = (row["part"] - 1) * 4096
        out[start : start + 4096] = row["bits"]
    return bytes(out)


def passes(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set, bits being the bitmap as an array of bytes."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
