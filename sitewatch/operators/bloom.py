"""A Bloom filter as a small table, to dismiss rows at a scan before anything is shuffled.

The filter is in blocks of 512 bits, a row each: a key sets a few bits of one block, so
testing a row is one broadcast lookup and a few bit operations, all in the JVM.  It
has ``BITS_PER_KEY`` bits a key up to ``MOST_BLOCKS`` blocks (16 MB), which bounds what is
broadcast; beyond that more rows pass in vain, and none is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, PROBES = 8, 6            # of 64 bits in a block; bits set by a key, 9 bits of a hash each
BITS_PER_KEY, MOST_BLOCKS = 16, 1 << 18


def _block(keys: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def _places(keys: Sequence[str]) -> list[Column]:
    """Places of a key's bits in its block."""
    h = F.xxhash64(F.lit(1), *keys)
    return [F.shiftright(h, 9 * i).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int") for i in range(PROBES)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)))


def bloom_filter(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """The filter (block, w0 ...) of the rows' keys, and its number of blocks; reads ``rows`` twice."""
    blocks = max(1, min(MOST_BLOCKS, rows.count() * BITS_PER_KEY // (64 * WORDS)))
    one = rows.select(_block(keys, blocks).alias("_block"), F.explode(F.array(*_places(keys))).alias("_place"))
    word = F.shiftright("_place", 6)
    return one.groupBy("_block").agg(*[F.bit_or(F.when(word == w, _bit(F.col("_place"))).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}")
                                       for w in range(WORDS)]), blocks


def may_hold(df: DataFrame, keys: Sequence[str], bloom: tuple[DataFrame, int], absent: bool = False) -> DataFrame:
    """The rows of ``df`` whose keys may be in the filter: all that are, and few others.
    With ``absent`` the other rows: those whose keys are not in it for certain."""
    table, blocks = bloom
    words = F.array(*[F.col(f"_w{w}") for w in range(WORDS)])
    hit = F.lit(True)
    for place in _places(keys):
        hit = hit & (F.get(words, F.shiftright(place, 6)).bitwiseAND(_bit(place)) != 0)
    keyed = df.withColumn("_block", _block(keys, blocks))
    probed = keyed.join(F.broadcast(table), "_block", "left" if absent else "inner")       # at most MOST_BLOCKS rows
    return probed.filter(~F.coalesce(hit, F.lit(False)) if absent else hit).select(*df.columns)
