"""Seeded row hashes: the only source of randomness over rows.

Every random choice about a row is a function of a seed and the row's own id,
so it is the same under any partitioning, retry or recomputation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_NULL_ID = "\\N"


def row_digest(seed: int, ids: Sequence[str]) -> Column:
    """Uniform 128-bit hash as 32 hex digits, which any engine can reproduce.

    Its text order is its numeric order, so a prefix is a histogram bucket.
    """
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(_NULL_ID)) for c in ids]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def digest_below(digest: Column, fraction: float) -> Column:
    """True for the given fraction of digests."""
    if fraction >= 1.0:
        return F.lit(True)
    limit = int(max(fraction, 0.0) * 2**32)
    return F.substring(digest, 1, 8) < F.lit(f"{limit:08x}")


def unit_interval(seed: int | Column, *values: Column) -> Column:
    """Fast uniform double in [0, 1) from the seed and values."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.shiftrightunsigned(F.xxhash64(seed, *values), 11) * F.lit(2.0**-53)
