"""Rows that a join would drop are dropped before they move.

The keys of the short side set bits of a bitmap, which is sent to all tasks. Rows whose bit isn't set
have no partner; of the others few have none, and the join that follows drops those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, as far as MOST_BITS (16 MB) allow; with more keys the bitmap fills, and more rows move than need to.
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) != 0


def sieve(rows: DataFrame, one: DataFrame, on: str, of: str | None = None) -> DataFrame:
    """The ``rows`` whose ``on`` may be among the ``of`` (by default ``on``) of the short, kept table ``one``. Nulls are keys like others."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * one.count()).bit_length()))
    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(size))
    slots = one.select(slot(of or on).alias("slot")).select(F.bitmap_bucket_number("slot").alias("bucket"), F.bitmap_bit_position("slot").alias("at"))
    bitmap = slots.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    met = (F.bitmap_bucket_number(slot(on)) == F.col("bucket")) & _is_set(F.col("bits"), F.bitmap_bit_position(slot(on)))
    return rows.join(F.broadcast(bitmap), met, "left_semi")
