"""Bitmaps of hashed keys, of bounded size, to broadcast as filters before a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Bits:
    """Answers `may contain` for 64-bit keys; a wrong yes costs work, never rows."""

    def __init__(self, words: np.ndarray, mask: int):
        self.words, self.mask = words, mask

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for shift in (0, 33):
            at = (keys >> np.uint64(shift)) & np.uint64(self.mask)
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def bitmap(keys: DataFrame, key: str, n: int, max_bits: int = 1 << 27) -> Bits:
    """The Bits of a column of mixed 64-bit keys: about 16 bits for each of n keys, max_bits (16 MB) at most,
    set by a grouped OR over 64-bit words; the driver gathers those words alone."""
    bits = 1 << max(10, min(max_bits.bit_length() - 1, (16 * max(n, 1)).bit_length()))

    def place(shift: int) -> Column:
        return F.shiftrightunsigned(key, shift).bitwiseAND(bits - 1)

    at = keys.select(F.explode(F.array(place(0), place(33))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return Bits(out, bits - 1)
