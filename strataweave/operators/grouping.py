"""Codebase groups under a cap, and grouped stratified folds.

Both are greedy and order-dependent. Merges whose turn can't depend on each other run in one round, in the order's result. The
folds stream through one task, as each choice needs the one before; it holds rows by fold and class only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.graph import connected_components
from strataweave.operators.numbering import numbered
from strataweave.session import forget, materialize, ship

#: codebase pairs that are merged in one task
ONE_TASK = 100_000


class Forest:
    """Disjoint sets; the root of a set is its least member."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        path = []
        while (parent := self.up.get(x, x)) != x:
            path.append(x)
            x = parent
        for y in path:
            self.up[y] = x
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _merge(cap: int):
    """Greedy merges within one component: rows p, q, n_p, n_q, j, row_a, row_b to (codebase, root)."""

    def run(pairs):
        import pandas as pd

        size = {**dict(zip(pairs["q"], pairs["n_q"], strict=True)), **dict(zip(pairs["p"], pairs["n_p"], strict=True))}
        forest = Forest()
        names = sorted(size)
        for p, q in pairs.sort_values(["j", "row_a", "row_b"])[["p", "q"]].itertuples(index=False):
            a, b = forest.root(p), forest.root(q)
            if a != b and size[a] + size[b] <= cap:
                total = size[a] + size[b]
                forest.join(a, b)
                size[forest.root(a)] = total
        return pd.DataFrame({"codebase": names, "root": [forest.root(c) for c in names]})

    return run


def _order(row: str = "") -> list:
    return [f"{row}{c}" for c in ("j", "row_a", "row_b")]


def _merge_round(pairs: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(merges, pairs left) after all pairs merge that are the strongest at both their groups; both written.

    pairs: p < q, n_p, n_q, j, row_a, row_b, of two groups whose rows fit the cap. Pairs that come to lie within a group, or whose groups no longer fit (they
    only grow), go; of pairs of the same two groups the strongest stays.
    """
    ends = pairs.select(F.explode(F.array("p", "q")).alias("node"), F.struct(*_order()).alias("o"))
    best = ends.groupBy("node").agg(F.min("o").alias("o")).select("node", "o.*")
    at = lambda end: best.withColumnRenamed("node", end)
    merges = materialize(pairs.join(at("p"), ["p", *_order()]).join(at("q"), ["q", *_order()]).select("p", "q", (F.col("n_p") + F.col("n_q")).alias("n")), "merges")
    moved = merges.select(F.explode(F.array("p", "q")).alias("node"), F.col("p").alias("root"), "n")
    of = lambda end: moved.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"), F.col("n").alias(f"now_{end}"))
    there = pairs.join(of("p"), "p", "left").join(of("q"), "q", "left")
    end = lambda e: F.struct(F.coalesce(f"root_{e}", e).alias("g"), F.coalesce(f"now_{e}", f"n_{e}").alias("n"))
    placed = there.select(F.least(end("p"), end("q")).alias("x"), F.greatest(end("p"), end("q")).alias("y"), F.struct(*_order()).alias("o")).where((F.col("x.g") != F.col("y.g")) & (F.col("x.n") + F.col("y.n") <= cap))
    strongest = placed.groupBy("x", "y").agg(F.min("o").alias("o"))
    left = materialize(strongest.select(F.col("x.g").alias("p"), F.col("y.g").alias("q"), F.col("x.n").alias("n_p"), F.col("y.n").alias("n_q"), "o.*"), "codebase-pairs")
    return merges, left


def capped_groups(rows: DataFrame, pairs: DataFrame, cap: int = 300, one_task: int = ONE_TASK) -> DataFrame:
    """(codebase, group_id): codebases merged along near-duplicate pairs, strongest first, while the merged rows stay within ``cap``.

    rows: row_id, codebase. Of the pairs between two codebases, the merge depends
    only on the strongest: a later one meets the same groups or larger ones. So
    each codebase pair is reduced to its maximum. A pair that is the strongest left at both its groups comes before all that could
    change these groups, so all such pairs are settled in one round, as the order would. When at most ``one_task`` pairs are left,
    one task settles these in order. Groups are numbered by their least codebase. cap 0: no merges.
    """
    sizes = rows.groupBy("codebase").agg(F.count("*").alias("n"))
    rooted = sizes.select("codebase", F.col("codebase").alias("root"))
    if cap > 0:
        name = lambda end: rows.select(F.col("row_id").alias(f"row_{end}"), F.col("codebase").alias(f"code_{end}"))
        linked = pairs.join(name("a"), "row_a").join(name("b"), "row_b").where("code_a != code_b")
        strongest = linked.groupBy(F.least("code_a", "code_b").alias("p"), F.greatest("code_a", "code_b").alias("q")).agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "row_a", "row_b")).alias("o"))
        of = lambda end: sizes.select(F.col("codebase").alias(end), F.col("n").alias(f"n_{end}"))
        flat = strongest.select("p", "q", "o.*").join(of("p"), "p").join(of("q"), "q").where(F.col("n_p") + F.col("n_q") <= cap)
        left = materialize(flat.select("p", "q", "n_p", "n_q", *_order()), "codebase-pairs")
        merged = None
        while left.count() > one_task:
            merges, after = _merge_round(left, cap)
            forget(left)
            left, merges = after, merges.select("p", "q")
            merged = merges if merged is None else materialize(merged.unionByName(merges), "merged")
        last = left.groupBy(F.lit(0).alias("one")).applyInPandas(_merge(cap), "codebase string, root string").where("codebase != root").select(F.col("root").alias("p"), F.col("codebase").alias("q"))
        merged = last if merged is None else merged.unionByName(last)
        # merges are a forest, whose trees are the groups
        roots = connected_components(merged, "p", "q")
        rooted = sizes.select("codebase").join(roots.select(F.col("node").alias("codebase"), F.col("component").alias("root")), "codebase", "left").select("codebase", F.coalesce("root", "codebase").alias("root"))
    rooted = materialize(rooted, "roots")
    return rooted.join(numbered(rooted.select("root").distinct(), "group_id", F.col("root")), "root").select("codebase", "group_id")


def group_sizes(rows: DataFrame, group: str = "codebase") -> DataFrame:
    """One row: how many groups, rows of the largest, mean rows."""
    return rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.max("n").alias("largest_rows"), F.avg("n").alias("mean_rows"))


def _choose_folds(n_folds: int, seed: int, total: dict[int, int], n_rows: int):
    """(group_id, fold) of groups in order (group_id, n, classes as cls and n), one choice after another."""

    def draw(*x) -> str:
        return hashlib.sha1("|".join(map(str, (seed, *x))).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want_rows = n_rows / n_folds
        have_rows, have = [0] * n_folds, [dict.fromkeys(total, 0) for _ in range(n_folds)]
        for batch in batches:
            folds = []
            for g, n, classes in zip(batch.column("group_id").to_pylist(), batch.column("n").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                rows_need = [(want_rows - h) / want_rows for h in have_rows]
                need = [sum(1 - have[f][k["cls"]] * n_folds / total[k["cls"]] for k in classes) + 0.5 * rows_need[f] if classes else rows_need[f] for f in range(n_folds)]
                best = [f for f in range(n_folds) if math.isclose(need[f], max(need), rel_tol=1e-5, abs_tol=1e-8)]
                f = min(best, key=lambda f, g=g: draw("fold", g, f))
                folds.append(f)
                have_rows[f] += n
                for k in classes:
                    have[f][k["cls"]] += k["n"]
            yield pa.RecordBatch.from_arrays([batch.column("group_id"), pa.array(folds, pa.int64())], names=["group_id", "fold"])

    return run


def stratified_folds(rows: DataFrame, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """(group_id, fold): whole groups to folds, so that each gets its part of every class and of the rows; written.

    rows: group_id, labels. Groups with the rarest classes go first, then more labels,
    then more rows; ties by a seeded hash. A labelled group goes where its classes are
    needed most, plus half the need of rows; others where rows are needed. What leaves the rows is one short row for each group, and
    the classes' totals reach the driver. Each choice depends on all before, so the sorted groups stream through one task.
    """
    ship(rows.sparkSession)
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("n"))
    cells = materialize(rows.select("group_id", F.explode("labels").alias("cls")).groupBy("group_id", "cls").agg(F.count("*").alias("n")), "group-classes")
    totals = cells.groupBy("cls").agg(F.sum("n").alias("t"))
    total = {r["cls"]: r["t"] for r in totals.collect()}  # a row for each class
    own = cells.join(totals, "cls").groupBy("group_id").agg(F.min("t").alias("rarest"), F.sum("n").alias("positives"), F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("classes"))
    none = F.array().cast(own.schema["classes"].dataType)
    groups = materialize(sizes.join(own, "group_id", "left").select("group_id", "n", "rarest", F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("classes", none).alias("classes")), "groups")
    tie = F.sha1(F.concat(F.lit(f"{seed}|group|"), F.col("group_id").cast("string")))
    order = [F.col("rarest").asc_nulls_last(), F.desc("positives"), F.desc("n"), tie]
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    return materialize(groups.repartition(1).sortWithinPartitions(*order).select("group_id", "n", "classes").mapInArrow(_choose_folds(n_folds, seed, total, n_rows), "group_id long, fold long"), "folds")
