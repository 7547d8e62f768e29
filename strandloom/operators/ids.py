"""Gapless ids and row numbers in a given order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import materialise, release

BLOCK = 1 << 20


def ordered_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """df with ids 0, 1, ... by `order`: range partitions, positions in each, and one offset per partition. df is read twice, so it should be cheap to read."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    release(spark)  # the rows lie written and shuffled now
    part = F.shiftright("__at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(starts, "part long, base long")
    local = F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn(name, F.col("base") + local).drop("part", "base", "__at")


def row_numbers(df: DataFrame, key: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """df with numbers 0, 1, ... within each key by the whole number `order`. Blocks of the order are numbered apart and shifted by the rows before them, so a key with very many rows isn't one task."""
    rows = df.withColumn("__block", F.floor(F.col(order) / block))
    sizes = rows.groupBy(*key, "__block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("__block")) - F.col("n")
    local = F.row_number().over(Window.partitionBy(*key, "__block").orderBy(order)) - 1
    joined = rows.withColumn("__local", local).join(sizes.select(*key, "__block", before.alias("__before")), [*key, "__block"])
    return joined.withColumn(name, (F.col("__local") + F.col("__before")).cast("int")).drop("__block", "__local", "__before")
