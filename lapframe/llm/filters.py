"""A filter of fixed size for rows whose key may be among wanted ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 8 MiB whatever the number of keys, so it may be broadcast.
BITS = 1 << 26
_PER_MAP = 32_768  # bits of one value of bitmap_construct_agg


def may_be_among(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows whose ``key`` (a hash, long) has its bit set; all rows with a wanted key are among them.

    It spares the shuffle of rows that the exact join after it would drop. With far more than
    ``BITS`` wanted keys it lets most rows pass, and the join alone decides.
    """
    slots = wanted.select(F.pmod(wanted_key, F.lit(BITS)).alias("slot"))
    maps = slots.groupBy(F.floor(F.col("slot") / _PER_MAP).cast("int").alias("__map")).agg(F.bitmap_construct_agg(F.col("slot") % _PER_MAP).alias("__bits"))
    slot = F.pmod(key, F.lit(BITS))
    placed = rows.withColumn("__slot", slot).withColumn("__map", F.floor(F.col("__slot") / _PER_MAP).cast("int"))
    is_set = F.expr(f"shiftright(CAST(conv(hex(substring(__bits, CAST((__slot % {_PER_MAP}) div 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST(__slot % 8 AS INT)) & 1") == 1
    return placed.join(F.broadcast(maps), "__map").where(is_set).select(*rows.columns)
