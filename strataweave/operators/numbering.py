"""Positions of rows in a global order, without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import materialize

#: low bits of a monotonically increasing id: the row within its partition
_ROW_BITS = 33


def numbered(rows: DataFrame, name: str, *order: Column, width: int = 0) -> DataFrame:
    """Add ``name``: the 0-based position of each row in the given order; ties in any order.

    One range shuffle; a partition's rows count up from the number of rows in those before it. That table has
    one row for each partition, so it is broadcast.
    """
    marked = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    written = materialize(marked, "numbered", width)
    part = F.shiftright("_m", _ROW_BITS).alias("_part")
    counts = written.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = written.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_m", "_part", "_before")


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], names: list[str]) -> DataFrame:
    """Add ``<name>_sum``: sums within the keys up to and with each row in the given order, which has no ties.

    One range shuffle spreads a key's rows over as many partitions as they fill: sums within each partition, plus those of the key's earlier
    partitions, of which there is one row for each partition and key. Keys may be null.
    """
    marked = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    written = materialize(marked, "running")
    totals = written.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_{c}") for c in names])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("_part").alias("_at"), *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in names])
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = written.withColumns({f"{c}_sum": F.sum(c).over(within) for c in names})
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    met = inner.join(before, same)
    return met.select(*rows.columns, *[(F.col(f"{c}_sum") + F.col(f"_before_{c}")).alias(f"{c}_sum") for c in names])
