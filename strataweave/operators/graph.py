"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.session import forget, materialize


#: edges of a node from which a round is joined in written steps
HUB = 1_000_000


def _stars(edges: DataFrame, large: bool, written: bool) -> DataFrame:
    """One star round. large: every larger neighbour is hung on the node's smallest neighbour; else the smaller ones and the node itself.

    ``written``: the minima go through a table, so that the join is one of plain shuffles, which AQE can split at a hub.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if written:
        least = materialize(least, "least")
    hung = sides.join(least, "a")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
    if written:
        out = materialize(out, "edges")
        forget(least)
    return out


def _most(edges: DataFrame) -> int:
    """Edges of the node with most on one side; counted with a map-side combine."""
    ends = edges.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("x")), F.struct(F.lit(1).alias("side"), F.col("b").alias("x")))).alias("e"))
    return ends.groupBy("e").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def connected_components(edges: DataFrame, a: str | Column = "a", b: str | Column = "b", max_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """(node, component): the smallest node of each component, for every node with an edge.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each is a
    map-side combined minimum and an equi-join, so no neighbourhood is gathered in
    one place; where a node has ``hub`` edges and more, AQE can split it. Each round is written to the shared
    folder; the rounds end when count and checksum of the edges stand still.
    Edges with a null end and loops are dropped; repeated edges count once; no
    edges give an empty result.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    now = materialize(edges.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null and a != b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark["n"] == 0 or seen == tuple(mark):
            break
        seen = tuple(mark)
        if mark["n"] >= hub and _most(now) >= hub:
            between = _stars(now, True, True)
            after = _stars(between, False, True)
            forget(between)
        else:
            after = materialize(_stars(_stars(now, True, False), False, False), "edges")
        forget(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
