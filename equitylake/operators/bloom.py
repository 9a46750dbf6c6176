"""Membership filter for sets of any size: a blocked Bloom filter as a table.

A key belongs to one block of 32,768 bits and sets ``HASHES`` bits there. The
filter is one aggregation of the keys (``bitmap_construct_agg``, combined
map-side), one row a block; there are as many blocks as ``BITS_PER_KEY`` asks for,
but at most ``MAX_BLOCKS``, so the table is at most 64 MB and may be broadcast
whatever the number of keys: beyond some 44 million keys it only lets more others
pass. Testing is a broadcast join on the block and a look at the bits, all in the
JVM, so wide rows are dropped before anything reads them.

A row whose key is in the set always passes; of others, about one in 400 at
``BITS_PER_KEY`` = 12. NULL keys never pass and are not in any set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768  # fixed by bitmap_construct_agg
HASHES = 5
BITS_PER_KEY = 12
MAX_BLOCKS = 1 << 14


def n_blocks(keys: int) -> int:
    return min(max(1, -(-keys * BITS_PER_KEY // BLOCK_BITS)), MAX_BLOCKS)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), key), F.lit(BLOCK_BITS))


def build(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, bits) of the non-NULL values of a column."""
    key = F.col(column)
    return (keys.where(key.isNotNull())
            .select(_block(key, blocks).alias("block"), F.explode(F.array(*[_bit(key, k) for k in range(HASHES)])).alias("bit"))
            .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")))


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1


def might_contain(rows: DataFrame, column: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be in the set of ``filter_`` (``build`` with the same
    ``blocks``)."""
    key = rows[column]
    f = F.broadcast(filter_.select(F.col("block").alias("_bloom_block"), F.col("bits").alias("_bloom_bits")))
    hit = _block(key, blocks) == F.col("_bloom_block")
    passes = F.lit(True)
    for k in range(HASHES):
        passes = passes & _is_set(F.col("_bloom_bits"), _bit(key, k))
    return rows.where(key.isNotNull()).join(f, hit).where(passes).select(*[rows[c] for c in rows.columns])


def prefilter(rows: DataFrame, column: str, keys: DataFrame, key_column: str) -> DataFrame:
    """Rows whose key may be among ``keys``, without moving ``rows``; counts the keys."""
    blocks = n_blocks(keys.count())
    return might_contain(rows, column, build(keys, key_column, blocks), blocks)
