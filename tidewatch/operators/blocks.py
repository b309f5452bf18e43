"""Time blocks: bounded window groups for entities of any length.

Every per-entity window in this package runs over ``(stay_id, block)`` where a
block covers ``BLOCK_HOURS`` consecutive hours (hours count from 0).  Halo rows feed
trailing frames across the border; what running values know at the end of a block goes
on to the later blocks of the entity.  An entity within one block takes the same path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.spec import HOUR

BLOCK_HOURS = 4096


def block_of(hour: Column, block_hours: int) -> Column:
    """An hour's block; hours below 0 are refused, so block 0 has none before it."""
    return F.when(hour >= 0, F.floor(hour / block_hours)).otherwise(F.raise_error(F.lit("hours count from 0"))).cast("long")


def with_blocks(df: DataFrame, block_hours: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Add ``block`` and ``halo``.

    A row within ``back`` hours of its block's end is repeated in the next block,
    one within ``ahead`` hours of its block's start in the previous block; these
    copies have ``halo = true``.
    """
    if max(back, ahead) >= block_hours:
        raise ValueError("a halo must be shorter than a block")
    own = block_of(F.col(HOUR), block_hours)
    offset = F.pmod(F.col(HOUR), F.lit(block_hours))
    homes = [own]
    if back:
        homes.append(F.when(offset >= block_hours - back, own + 1))
    if ahead:
        homes.append(F.when(offset < ahead, own - 1))
    spread = df.withColumn("block", F.explode(F.array_compact(F.array(*homes))))
    return spread.withColumn("halo", F.col("block") != own)
