"""Exact duplicates with label union, and class selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.text import content_hash, lines
from strataweave.session import materialize

PROJECT_LEVEL = ("SWC-102", "SWC-103")


def exact_duplicates(files: DataFrame, text: str = "text", path: str = "rel_path", directory: str = "audit_dir", labels: str = "swc") -> DataFrame:
    """One row for each normalised content: the copy with most distinct labels, then the smallest path.

    Adds norm_hash, content_id, n_copies, copy_audit_dirs, and swc_all: the labels of all copies. labels is an array.
    """
    rank = F.struct(-F.size(labels), F.col(path))
    own = F.struct(*[c for c in files.columns])
    grouped = files.groupBy(content_hash(F.col(text)).alias("norm_hash")).agg(
        F.min_by(own, rank).alias("rep"), F.count("*").alias("n_copies"), F.array_sort(F.collect_set(directory)).alias("copy_audit_dirs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(labels)))).alias("swc_all")
    )
    return grouped.select("rep.*", "norm_hash", F.substring("norm_hash", 1, 16).alias("content_id"), "n_copies", "copy_audit_dirs", "swc_all")


def _strip(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def nearest_place(places: Column, guess: Column) -> Column:
    """The number of an ascending array closest to ``guess`` (ties: the smaller one), by binary search."""
    # how many are below the guess: between low and high
    halved = lambda r: F.floor((r["low"] + r["high"]) / 2).cast("int")
    below = lambda r: F.element_at(places, halved(r) + 1) < guess
    step = lambda r, _: F.when(r["low"] >= r["high"], r).otherwise(F.struct(F.when(below(r), halved(r) + 1).otherwise(r["low"]).alias("low"), F.when(below(r), r["high"]).otherwise(halved(r)).alias("high")))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(places) + 1)).cast("int"))
    n = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(places).alias("high")), step, lambda r: r["low"])
    left, right = F.try_element_at(places, F.when(n > 0, n)), F.try_element_at(places, n + 1)
    return F.when(right.isNull() | (guess - left <= right - guess), left).otherwise(right)


def map_spans(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans of copies on the lines of their representatives. spans: span_id, src, dst, start, end; adds new_start, new_end. texts: text_id (unique), text.

    An end is the equal stripped line nearest to the same relative place (ties: the
    upper one); if one end has none, the span covers the whole file. Each text in use is cut into lines once, however many spans it has: into a
    written table (text, line, place) and an index (text, line, ascending places), in which an end finds its place by binary search.
    A null text counts as empty; spans may be null or lie beyond the text.
    """
    used = spans.select(F.explode(F.array("src", "dst")).alias("text_id")).distinct()
    cut = materialize(texts.join(used, "text_id", "left_semi").select("text_id", F.posexplode(lines(F.coalesce("text", F.lit("")))).alias("i", "line")).select("text_id", (F.col("i") + 1).alias("n"), _strip(F.col("line")).alias("line")), "lines")
    size = cut.groupBy("text_id").agg(F.count("*").cast("int").alias("size"))
    sized = materialize(spans.join(size.select(F.col("text_id").alias("src"), F.col("size").alias("n_src")), "src").join(size.select(F.col("text_id").alias("dst"), F.col("size").alias("n_dst")), "dst"), "spans")
    ends = sized.select("span_id", "src", "dst", "n_src", "n_dst", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("start").cast("int").alias("n")), F.struct(F.lit("b").alias("side"), F.col("end").cast("int").alias("n")))).alias("e")).select("span_id", "src", "dst", "n_src", "n_dst", "e.*")
    wanted = materialize(ends.join(cut.withColumnRenamed("text_id", "src"), ["src", "n"]).where("line != ''"), "ends")
    index = cut.where("line != ''").groupBy(F.col("text_id").alias("dst"), "line").agg(F.array_sort(F.collect_list("n")).alias("places"))
    guess = F.col("n") * F.col("n_dst") / F.greatest(F.col("n_src"), F.lit(1))
    found = wanted.join(index, ["dst", "line"]).select("span_id", "side", nearest_place(F.col("places"), guess).alias("hit"))
    both = found.groupBy("span_id").agg(F.max(F.when(F.col("side") == "a", F.col("hit"))).alias("_a"), F.max(F.when(F.col("side") == "b", F.col("hit"))).alias("_b"))
    joined = sized.join(both, "span_id", "left")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.select(*spans.columns, F.when(ok, F.least("_a", "_b")).otherwise(F.lit(1)).alias("new_start"), F.when(ok, F.greatest("_a", "_b")).otherwise(F.col("n_dst")).alias("new_end"))


def map_spans_by_text(spans: DataFrame) -> DataFrame:
    """As ``map_spans`` for spans (span_id, src, dst, start, end) that bring their texts; equal texts are cut into lines once."""
    name = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    texts = spans.select(F.explode(F.array("src", "dst")).alias("text")).select(name("text").alias("text_id"), "text").dropDuplicates(["text_id"])
    return map_spans(spans.select("span_id", name("src").alias("src"), name("dst").alias("dst"), "start", "end"), texts).drop("src", "dst")


def select_classes(files: DataFrame, labels: str = "swc_all", least_files: int = 20, keep_project_level: bool = False, eval_least_files: int = 0) -> DataFrame:
    """(swc, n_files, status, cls, scored): status is included, rare or project_level; cls numbers included classes by count, then id."""
    counts = files.select(F.explode(labels).alias("swc")).groupBy("swc").agg(F.count("*").alias("n_files"))
    project = F.lit(False) if keep_project_level else F.col("swc").isin(*PROJECT_LEVEL)
    status = F.when(project, "project_level").when(F.col("n_files") >= least_files, "included").otherwise("rare")
    # one row for each class: a small window
    number = F.row_number().over(Window.partitionBy("status").orderBy(F.desc("n_files"), "swc")) - 1
    return counts.withColumn("status", status).withColumn("cls", F.when(F.col("status") == "included", number)).withColumn("scored", (F.col("status") == "included") & (F.col("n_files") >= eval_least_files))


def label_rows(files: DataFrame, classes: DataFrame, labels: str = "swc_all") -> DataFrame:
    """Adds labels (sorted class numbers) and excluded: files of which every class is rare or project-level, with one rare."""
    flat = files.select("norm_hash", F.explode(labels).alias("swc")).join(classes, "swc")
    per_file = flat.groupBy("norm_hash").agg(F.array_sort(F.collect_list("cls")).alias("labels"), F.bool_or(F.col("status") == "rare").alias("_rare"))
    joined = files.join(per_file, "norm_hash", "left")
    none = F.array().cast("array<int>")
    return joined.withColumn("labels", F.coalesce("labels", none)).withColumn("excluded", F.coalesce(F.col("_rare") & (F.size("labels") == 0), F.lit(False))).drop("_rare")


def multi_hot(labels: Column, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.array_contains(labels, k).cast("int"))


def thin_classes(rows: DataFrame, classes: DataFrame, n_folds: int, least: int = 3) -> DataFrame:
    """(cls, least, thin): positives in the fold with fewest, and whether that is below ``least``; folds without any count."""
    few = F.min("positives")
    return per_fold_counts(rows, classes, n_folds).groupBy("cls").agg(few.alias("least"), (few < least).alias("thin"))


def split_distribution(rows: DataFrame, labels: str = "labels", test_fold: int = 0, val_fold: int = 1) -> DataFrame:
    """(split, label, files): files of each label in train, val and test. rows: fold and an array of labels."""
    split = F.when(F.col("fold") == test_fold, "test").when(F.col("fold") == val_fold, "val").otherwise("train")
    return rows.select(split.alias("split"), F.explode(labels).alias("label")).groupBy("split", "label").agg(F.count("*").alias("files"))


def per_fold_counts(rows: DataFrame, classes: DataFrame, n_folds: int) -> DataFrame:
    """(cls, fold, positives) on the whole grid, zeros included."""
    grid = classes.where("cls is not null").select("cls").crossJoin(rows.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("fold")))
    seen = rows.select("fold", F.explode("labels").alias("cls")).groupBy("cls", "fold").agg(F.count("*").alias("positives"))
    return grid.join(seen, ["cls", "fold"], "left").select("cls", "fold", F.coalesce("positives", F.lit(0)).alias("positives"))
