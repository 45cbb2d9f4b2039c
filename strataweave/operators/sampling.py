"""Splits, balancing and resampling, decided by seeded hashes.

Which rows are taken depends on a hash of seed and id, so a sample is the same
on every cluster. Ranks are taken through hash ranges where a partition key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators.numbering import numbered


def draw(seed: int | Column, *keys: str | Column) -> Column:
    parts = [F.lit(seed).cast("string") if not isinstance(seed, Column) else seed.cast("string"), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.sha1(F.concat_ws("|", *parts))


def split_folds(rows: DataFrame, test_fold: int = 0, val_fold: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, val, test); test and val must have rows. The filters reach the Parquet scan."""
    have = {r["fold"] for r in rows.where(F.col("fold").isin(test_fold, val_fold)).select("fold").distinct().collect()}
    if lost := {test_fold, val_fold} - have:
        raise ValueError(f"no rows in folds {sorted(lost)}")
    return rows.where(~F.col("fold").isin(test_fold, val_fold)), rows.where(F.col("fold") == val_fold), rows.where(F.col("fold") == test_fold)


def ranked(rows: DataFrame, by: list[str], order: Column, name: str = "rank", bits: int = 2) -> DataFrame:
    """1-based rank of rows within ``by`` in the order of a hex hash: counts of hash ranges, then ranks within one.

    No group is sorted in one task: a range has 16**-bits of it.
    """
    keyed = rows.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, bits))
    counts = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).drop("_n")
    within = keyed.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_o")))
    return within.join(before, [*by, "_b"]).withColumn(name, F.col("_k") + F.col("_before")).drop("_o", "_b", "_k", "_before")


def balance(rows: DataFrame, safe_ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """All labelled rows and, in each fold, ratio times as many unlabelled ones (half-even rounding, no repeats)."""
    labelled = rows.where(F.size("labels") > 0)
    want = labelled.groupBy("fold").agg(F.bround(F.count("*") * F.lit(safe_ratio), 0).cast("long").alias("_want"))
    others = ranked(rows.where(F.size("labels") == 0), ["fold"], draw(seed, "fold", "row_id"))
    taken = others.join(want, "fold").where(F.col("rank") <= F.col("_want")).drop("rank", "_want")
    return labelled.unionByName(taken.select(labelled.columns))


def cap_rows(rows: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows: up to half labelled, the rest unlabelled, both by hash; all rows if there are no more."""
    n = rows.count()
    if n <= cap:
        return rows
    some = rows.where(F.size("labels") > 0)
    first = some.orderBy(draw(seed, "row_id")).limit(cap // 2)
    n_first = min(some.count(), cap // 2)
    return first.unionByName(rows.where(F.size("labels") == 0).orderBy(draw(seed, "row_id")).limit(cap - n_first)).orderBy("row_id")


def oversample_copies(labelled: DataFrame, item: str, threshold: int, target: int, factor: float, seed: int) -> DataFrame:
    """(item, copy): drawn repeats of items of rare classes. labelled: item, cls.

    A class with c < threshold items gets int(min(target - c, (factor - 1) c)) repeats, drawn
    with replacement: repeat i takes the item at a hashed place of the class's hash order.
    Counts are taken once, before any repeat.
    """
    counts = labelled.groupBy("cls").agg(F.count("*").alias("c")).where(F.col("c") < threshold)
    need = F.least(F.lit(target) - F.col("c"), F.lit(factor - 1.0) * F.col("c")).cast("int")
    wanted = counts.select("cls", "c", need.alias("need")).where("need > 0")
    draws = wanted.select("cls", "c", F.explode(F.sequence(F.lit(1), "need")).alias("copy"))
    place = F.conv(F.substring(draw(seed, "cls", "copy"), 1, 8), 16, 10).cast("long") % F.col("c") + 1
    # only classes below the threshold are ranked, so a partition has less than threshold rows
    order = Window.partitionBy("cls").orderBy(draw(seed, "cls", item))
    pool = labelled.join(wanted.select("cls"), "cls", "left_semi").withColumn("_k", F.row_number().over(order))
    return draws.withColumn("_k", place).join(pool, ["cls", "_k"]).select(item, "cls", "copy")


def resample_windows(windows: DataFrame, neg_ratio: float = 0.3, threshold: int = 100, target: int = 300, factor: float = 5.0, seed: int = 42, oversample: bool = True) -> DataFrame:
    """Training windows in shuffled order: win_id, why, copy, position key.

    windows: win_id, labels (array), file_annotated. All positive windows, all negative
    ones of annotated files, a part of the other negatives, and repeats of rare classes.
    """
    positive = windows.where(F.size("labels") > 0).select("win_id", F.lit("positive").alias("why"), F.lit(0).alias("copy"))
    negative = windows.where(F.size("labels") == 0)
    hard = negative.where("file_annotated").select("win_id", F.lit("hard_negative").alias("why"), F.lit(0).alias("copy"))
    easy = negative.where("not file_annotated").withColumn("_g", F.lit(0))
    if neg_ratio < 1.0:
        keep = easy.agg(F.bround(F.count("*") * F.lit(neg_ratio), 0).cast("long").alias("_want"))
        easy = ranked(easy, ["_g"], draw(seed, "win_id"), bits=3).crossJoin(F.broadcast(keep)).where("rank <= _want")  # keep is one row
    out = positive.unionByName(hard).unionByName(easy.select("win_id", F.lit("easy_negative").alias("why"), F.lit(0).alias("copy")))
    if oversample:
        cells = windows.select("win_id", F.explode("labels").alias("cls"))
        out = out.unionByName(oversample_copies(cells, "win_id", threshold, target, factor, seed).select("win_id", F.lit("repeat").alias("why"), "copy"))
    return out.withColumn("position", draw(seed, "why", "win_id", "copy"))


def epoch_files(files: DataFrame, epoch: int, neg_ratio: float = 1.0, threshold: int = 50, target: int = 150, factor: float = 5.0, seed: int = 42) -> DataFrame:
    """Files of one epoch: every labelled one, a fresh draw of the others, repeats of rare classes. files: row_id, labels."""
    labelled = files.where(F.size("labels") > 0)
    others = files.where(F.size("labels") == 0).select("row_id").withColumn("_g", F.lit(0))
    if neg_ratio < 1.0:
        keep = others.agg(F.bround(F.count("*") * F.lit(neg_ratio), 0).cast("long").alias("_want"))
        others = ranked(others, ["_g"], draw(seed, F.lit(epoch), "row_id"), bits=3).crossJoin(F.broadcast(keep)).where("rank <= _want")  # keep is one row
    base = labelled.select("row_id", F.lit("labelled").alias("why"), F.lit(0).alias("copy")).unionByName(others.select("row_id", F.lit("unlabelled").alias("why"), F.lit(0).alias("copy")))
    cells = labelled.select("row_id", F.explode("labels").alias("cls"))
    repeats = oversample_copies(cells, "row_id", threshold, target, factor, seed + epoch).select("row_id", F.lit("repeat").alias("why"), "copy")
    return base.unionByName(repeats).withColumn("position", draw(seed, F.lit(epoch), "why", "row_id", "copy"))


def length_sorted(rows: DataFrame, length: str, key: str, parts: int) -> DataFrame:
    """Adds part: 1 to ``parts``, equal in rows up to one, of the rows in the order of length and key; rows of a part are alike in length. Numbered by one range shuffle."""
    placed = numbered(rows, "_at", F.col(length), F.col(key))
    n = rows.agg(F.count("*").alias("_n"))
    base, extra = F.floor(F.col("_n") / parts), F.col("_n") % parts
    after = extra + F.floor((F.col("_at") - extra * (base + 1)) / F.greatest(base, F.lit(1)))
    part = F.when(F.col("_at") < extra * (base + 1), F.floor(F.col("_at") / (base + 1))).otherwise(after) + 1
    return placed.crossJoin(F.broadcast(n)).withColumn("part", part.cast("int")).drop("_at", "_n")  # n is one row


def pack_files(files: DataFrame, window_batch: int, max_windows: int, seed: int = 42, by: str | None = None) -> DataFrame:
    """Whole files into forward passes of at most ``window_batch`` windows, in row order; a longer file goes alone.

    files: row_id, windows (array of ids); files with more than ``max_windows`` keep a seeded choice. Packing is
    sequential: within each value of the whole-number column ``by``, whatever the partitions, or without it within
    each partition as it stands. Returns (partition: that value or the partition's number, batch, row_id, windows).
    """
    chosen = F.when(F.size("windows") > max_windows, F.array_sort(F.transform(F.slice(F.array_sort(F.transform("windows", lambda w: F.struct(draw(seed, F.col("row_id"), w).alias("d"), w.alias("w")))), 1, max_windows), lambda s: s["w"]))).otherwise(F.col("windows"))
    group = F.spark_partition_id() if by is None else F.col(by)
    dealt = files if by is None else files.repartition(by)
    kept = dealt.select(group.cast("int").alias("partition"), "row_id", chosen.alias("windows")).sortWithinPartitions("partition", "row_id")

    def pack(batches):
        import pandas as pd

        last, batch, filled = None, 0, 0
        for pdf in batches:
            numbers = []
            for part, w in zip(pdf["partition"], pdf["windows"], strict=True):
                if part != last:
                    last, batch, filled = part, 0, 0
                elif filled and filled + len(w) > window_batch:
                    batch, filled = batch + 1, 0
                filled += len(w)
                numbers.append(batch)
            yield pdf.assign(batch=numbers)[["partition", "batch", "row_id", "windows"]]

    return kept.mapInPandas(pack, "partition int, batch long, row_id long, windows array<long>")
