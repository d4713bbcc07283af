"""Pseudorandom numbers from hashed keys: the same rows are drawn whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws lie in [0, SPAN).
SPAN = 4294967296


def draw(seed: int, *keys: Column) -> Column:
    """Uniform integer in [0, SPAN) from md5 of ``seed-key1-key2...``; null keys hash as an empty word."""
    text = F.concat_ws("-", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def drawn(portion: float, seed: int, *keys: Column) -> Column:
    """True for about ``portion`` of all keys."""
    return draw(seed, *keys) < F.lit(portion * SPAN)
