"""Joins on keys of which one may hold a third of all rows, or with tables too large for a broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the rows is hot. At most 1 / HOT_SHARE keys can be, so they may be broadcast.
HOT_SHARE = 0.001
#: Bits of a bitmap in Spark, and bits for each key.
BITMAP, BITS = 32768, 16


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Inner join of rows with table, which has one row per key and the key's number of rows in count_col.

    Rows of hot keys meet a broadcast of at most 1 / HOT_SHARE table rows and stay where they are; the others are shuffled.
    Both inputs should be cheap to read again.
    """
    floor = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(table.where(F.col(count_col) >= floor))
    cold = rows.join(F.broadcast(table.where(F.col(count_col) >= floor).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(table.where(F.col(count_col) < floor), keys))


def thin(rows: DataFrame, row_key: Column, table: DataFrame, table_key: Column, total: int) -> DataFrame:
    """The rows whose key may be among the `total` keys of table, and about one in BITS of the others, so that the join that follows shuffles few of them.

    Two bytes a key are broadcast, as bitmaps of places that keys are hashed to. Keys of both sides have one type; null is a key.
    """
    bits = BITMAP * (total * BITS // BITMAP + 1)
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(bits))
    at = lambda key, what: F.floor(place(key) / BITMAP).cast("int") if what == "map" else (place(key) % BITMAP).cast("long")
    maps = table.select(at(table_key, "map").alias("_map"), at(table_key, "bit").alias("_bit")).repartition("_map")  # places are shuffled, not bitmaps of each task
    maps = maps.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_bit div 8) + 1, 1)")), 16, 10).cast("int")
    found = rows.select("*", at(row_key, "map").alias("_map"), at(row_key, "bit").alias("_bit")).join(F.broadcast(maps), "_map")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, int(_bit % 8))")) != 0).drop("_map", "_bit", "_bits")
