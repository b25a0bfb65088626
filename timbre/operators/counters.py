"""Random numbers that are functions of a key and a counter, in 32-bit words that any engine can repeat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# --- fixed values: shifts and odd factors that scramble 32-bit counters --------
MIX = ((16, 0x7FEB352D), (15, 0x846CA68B))
# -----------------------------------------------------------------------------


def mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 32-bit numbers held in 64 bits."""
    for shift, factor in MIX:
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor) & np.uint64(0xFFFFFFFF)
    return values ^ (values >> np.uint64(16))


def key_word(key: Column, seed: int, number: int) -> Column:
    """The ``number``-th 32-bit word of the digest of (seed, key)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substr(digest, F.lit(8 * number + 1), F.lit(8)), 16, 10).cast("bigint")
