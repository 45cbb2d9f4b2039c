"""Joins of tables by place: overlapping intervals, and the last row at or before each of another table's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import materialize


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], width: int, a: tuple[str, str] = ("a0", "a1"), b: tuple[str, str] = ("b0", "b1")) -> DataFrame:
    """Pairs of rows with equal ``by`` whose closed intervals (whole numbers) share a place; columns of both, ``by`` once.

    Both sides are cut into bins of ``width`` places and meet in an equi-join by bin, so a file of many intervals is dealt over its bins; a pair
    comes out in the first bin that both reach. An interval costs a row for each bin: ``width`` near the usual length keeps that at a few.
    Null and empty intervals (end before start) overlap nothing, null keys meet nothing; repeated rows each make their pairs. Other columns of
    the two sides must have different names.
    """
    bins = lambda ends: F.explode(F.sequence(F.floor(F.col(ends[0]) / width), F.floor(F.col(ends[1]) / width)))
    cut = lambda side, ends: side.where(F.col(ends[0]) <= F.col(ends[1])).withColumn("_bin", bins(ends))
    met = cut(left, a).join(cut(right, b), [*by, "_bin"])
    first = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width)
    return met.where((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) & (F.col("_bin") == first)).drop("_bin")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str) -> DataFrame:
    """left with ``found``: the other columns of the last right row with equal ``by`` and a place ``at`` not beyond the left row's, or null.

    Both sides are put in one order by a range shuffle, so a key of many rows lies in several partitions; the last right row is carried
    on within each partition, and from earlier partitions by one row for each partition and key. Of right rows at one place the
    greatest by its columns counts. Null keys match null keys; a left row without a place finds nothing, right rows without one are passed over.
    """
    held = [c for c in right.columns if c not in by and c != at]
    value = F.struct(F.col(at).alias(at), *[F.col(c) for c in held])
    kind = right.select(value.alias("v")).schema["v"].dataType
    rows = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    marks = right.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), value.alias("_v"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    # places without a number come first, before any right row
    order = [F.col("_at").asc_nulls_first(), F.col("_side"), F.col("_v")]
    placed = materialize(marks.unionByName(rows).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "as-of")
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = placed.groupBy("_part", *by).agg(F.max("_v").alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(by)], F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(by):
        same &= F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    carried = placed.withColumn("_here", F.last("_v", ignorenulls=True).over(within)).where("_side = 1").join(before, same)
    return carried.select("_row.*", F.when(F.col("_at").isNotNull(), F.coalesce("_here", "_before")).alias("found"))
