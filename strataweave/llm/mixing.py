"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time 0..1, linear between
knots. Its integral says which part of the source's words is due by when; the
inverse gives every document its training position, and rows are range-sorted
by position. How many words a source gives in all follows from target weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.llm.textblocks import _NONSPACE, pieces, raw, strings, trimmed
from strataweave.session import materialize

WEIGHTS = (5, 2, 1)
#: weight over time by the source's place in WEIGHTS, at equally spaced knots
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))

#: bits of the hash that a source's documents stand in order of
HASH_BITS = 60


def word_counts(column: pa.Array) -> np.ndarray:
    buf, off = raw(column)
    word = _NONSPACE[buf]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = off[:-1]
    heads = heads[heads < len(buf)]
    start[heads] = word[heads]
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(start, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def with_size(docs: DataFrame, keep: list[str], text: str = "text", name: str = "size") -> DataFrame:
    """Columns ``keep`` and the number of words of the text (null: 0)."""
    keep = [c for c in keep if c != name]
    need = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(word_counts(strings(batch.column(text))))], names=[*keep, name])

    return docs.select(*need).mapInArrow(trimmed(run), T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.LongType())]))


def source_plan(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(_source, source_size, target, _place in weights) of sources (_source, source_size), null for the null source.

    Sources in code point order, null last, take the weights in turn. All share
    ``share`` times the total by weight; a target stops at ``most`` times its source's size and
    the excess is shared again until no target is above: in the order of size over weight,
    sources stop as long as their part of what those before leave is too large. Windows over one row for each source.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    placed = totals.withColumn("_place", (F.row_number().over(order) - 1) % len(weights))
    weight = F.lit(float(weights[-1]))
    for i in range(len(weights) - 2, -1, -1):
        weight = F.when(F.col("_place") == i, float(weights[i])).otherwise(weight)
    capped = placed.withColumn("_w", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    unit = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    due = capped.withColumn("_unit", unit).withColumn("_r", F.row_number().over(fill))
    free = F.when(F.col("_unit") * F.col("_w") <= F.col("_cap"), F.struct("_r", "_unit"))
    first = due.withColumn("_free", F.first(free, ignorenulls=True).over(every))
    target = F.when(F.col("_free").isNull() | (F.col("_r") < F.col("_free")["_r"]), F.col("_cap")).otherwise(F.col("_free")["_unit"] * F.col("_w"))
    return first.select("_source", "source_size", target.alias("target"), "_place")


def schedule_inverse(y: Column, knots: tuple[float, ...]) -> Column:
    """Time at which the fraction y of a schedule's integral is reached; the schedule is linear between equally spaced knots."""
    step = 1.0 / (len(knots) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False)]
    total = sum(areas)
    out, before = F.lit(1.0), 1.0
    for i in range(len(areas) - 1, -1, -1):
        a, b = knots[i], knots[i + 1]
        before -= areas[i] / total
        due = F.greatest(y - F.lit(before), F.lit(0.0)) * F.lit(total)  # area into this piece
        slope = (b - a) / step
        x = due / F.lit(a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + due * F.lit(2 * slope), F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        here = F.lit(i * step) + F.least(F.greatest(x, F.lit(0.0)), F.lit(step))
        out = here if i == len(areas) - 1 else F.when(y < F.lit(before + areas[i] / total), here).otherwise(out)
    return out


def mix_sources(docs: DataFrame, keep: list[str], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, seed: int = 23, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Columns ``keep``, then size, source_size, target, taken and passes (array of pass, words, position).

    A source's documents stand in the order of a seeded hash of key and text; the mix
    takes words from the front of that order, passing over it again when it ends, so
    exactly floor(target) words are taken and no document is taken more often than
    ``most`` rounded up. Offsets are two-level prefix sums (hash range, then row), so
    no source is gathered in one task. Words are counted once into a table; texts that are kept join it again by a second count. Null texts have size 0, a null source is a
    source; repeated rows are separate documents; an empty table gives none; columns
    named like an output, here or of ``training_order``, are replaced.
    """
    own = ["size", "source_size", "target", "taken", "passes", "pass", "words", "position"]
    keep = [c for c in keep if c not in {*own, "_source", "_hash", "_range", "_in", "_before", "_place", "_at"}]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit(""))))
    named = docs.withColumn("_source", F.col(source)).withColumn("_hash", F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long"))
    light = [c for c in keep if c != text]
    small = materialize(with_size(named.select(*dict.fromkeys([*light, "_source", "_hash", text])), [*light, "_source", "_hash"], text), "sizes")
    sized = small if light == keep else with_size(named.select(*dict.fromkeys([*keep, "_source", "_hash", text])), [*keep, "_source", "_hash"], text)
    totals = small.groupBy("_source").agg(F.sum("size").alias("source_size"))
    plan = source_plan(totals, weights, share, most)
    bits = max(1, int(np.ceil(np.log2(max(2, small.count())) / 2)))
    ranged = F.shiftright("_hash", HASH_BITS - bits)
    sums = small.groupBy("_source", ranged.alias("_range")).agg(F.sum("size").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_range")) - F.col("_sum")).drop("_sum")
    starts = materialize(before.join(plan, before["_source"].eqNullSafe(plan["_source"])).drop(plan["_source"]), "starts")
    run = Window.partitionBy("_source", "_range").orderBy("_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = sized.withColumn("_range", ranged).withColumn("_in", F.sum("size").over(run) - F.col("size"))
    same = (inner["_range"] == starts["_range"]) & inner["_source"].eqNullSafe(starts["_source"])
    placed = inner.join(starts, same).drop(starts["_source"], starts["_range"]).withColumn("_at", F.col("_before") + F.col("_in"))
    words = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - F.col("source_size") * e - F.col("_at")))
    y = lambda e: (F.col("source_size") * e + F.col("_at")) / F.greatest(F.col("target"), F.lit(1.0))

    def position(e: Column) -> Column:
        out = schedule_inverse(y(e), schedules[0])
        for i in range(1, len(weights)):
            out = F.when(F.col("_place") == i, schedule_inverse(y(e), schedules[i % len(schedules)])).otherwise(out)
        return out

    every = F.transform(F.sequence(F.lit(0), F.lit(int(np.ceil(most)) - 1)), lambda e: F.struct(e.alias("pass"), words(e).alias("words"), position(e).alias("position")))
    placed = placed.withColumn("passes", F.filter(every, lambda p: p["words"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return placed.select(*keep, "size", "source_size", "target", taken.alias("taken"), "passes")


def training_order(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document and pass, range-sorted by training position, pass and, if it is there, key."""
    flat = mixed.withColumn("_p", F.explode("passes")).select(*[c for c in mixed.columns if c != "passes"], F.col("_p.pass").alias("pass"), F.col("_p.words").alias("words"), F.col("_p.position").alias("position"))
    return flat.orderBy("position", "pass", *([key] if key in flat.columns else []))
