r"""Filter interaction audit: what every order of a set of filters removes, step by step, for each part of a corpus.

One pass over the texts gives each row a *mask* with a bit for each filter that it
fails. Filters are predicates of a row alone, so what an order does depends on the number of rows
with each mask only: these *cells* (at most 2**n a part) are all that leaves the documents.

The orders are visited by adjacent transpositions (Steinhaus-Johnson-Trotter, as Even
puts it): each differs from the one before in two neighbouring steps, and only these are counted anew from the cells; the rows
that reach the first of the two, and that leave the second, stay the same. Shapley totals
are taken along the walk: a filter's removed count goes in once for each order that it stood for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.llm.textblocks import Words, code_pairs, pieces, strings, trimmed
from strataweave.session import dealt, materialize

FILTERS = "ABCDE"
#: characters that filter D looks for (fixed values)
MARKS = b"#$%&*|"
#: filters in an audit at most: a part has up to 2**n cells and n! orders
MOST = 8

_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(MARKS)] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def text_masks(column: pa.Array) -> np.ndarray:
    """Bits 0 to 3 of each text without nulls: under 100 words; under 80 % distinct words; over 10 % ``A-Z``; holds a mark."""
    w = Words(column)
    distinct = np.bincount(np.unique(code_pairs(w.codes()[0], w.owner(), max(w.n, 1))) % max(w.n, 1), minlength=w.n)
    upper = _per_text((w.buf >= 65) & (w.buf <= 90), w.off)
    fails = [w.count < 100, 100 * distinct < 80 * w.count, 100 * upper > 10 * _per_text(_HEAD[w.buf], w.off), _per_text(_IS_MARK[w.buf], w.off) > 0]
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        mask = text_masks(strings(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("sha"), pa.array(mask)], names=["doc_id", "part", "sha", "mask"])


def document_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) for each row: filters A to D from the text, and E (bit 4) if a row with a smaller key has the same text.

    A null text counts as empty, a null part as the empty string. Rows with a null key don't fail E and make none fail it; rows that
    repeat key and text don't either. Texts are told apart by their SHA-256. The first key of each text is found with a map-side combine
    and meets the rows by (text, key), so a text of many copies is no hot key.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(value.cast("binary"), 256)).alias("sha"), value.alias("text"))
    rows = materialize(given.mapInArrow(trimmed(_read), "doc_id long, part string, sha binary, mask long"), "masks")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    met = dealt(rows, 0, "sha", "doc_id").join(first.hint("merge"), ["sha", "doc_id"], "left")
    return met.select("doc_id", "part", (F.col("mask") + F.when(copy, F.lit(1 << 4)).otherwise(F.lit(0))).cast("long").alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each mask, and those whose key has a label of quality 1 and of toxic 1.

    Several labels of one key count as one that is good, or toxic, if any is; keys without a label and null keys are neither.
    """
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"))
    met = masks.join(said, "doc_id", "left")
    return met.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def transpositions(n: int) -> Iterator[int]:
    """The swaps that visit all orders of n things from the identity: the place of the first of the two that change."""
    order, way = list(range(n)), [-1] * n
    place = list(range(n))
    while True:
        for x in range(n - 1, -1, -1):  # the largest that can move past a smaller neighbour
            at, to = place[x], place[x] + way[x]
            if 0 <= to < n and order[to] < x:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        place[order[at]], place[order[to]] = at, to
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield min(at, to)


class Walk:
    """One order of the filters at a time over cells (mask; rows of counts: all, good, toxic)."""

    def __init__(self, n: int, mask: np.ndarray, counts: np.ndarray):
        self.n, self.mask, self.counts = n, mask, counts
        self.order = list(range(n))
        bits = 1 << np.arange(n)
        self.alone = np.array([counts[0, mask == b].sum() for b in bits])
        self.fails = np.array([counts[0, (mask & b) != 0].sum() for b in bits])
        self.removed = np.zeros((n, 3), np.int64)  # at each step
        self.kept = np.zeros(n, np.int64)
        self.before = [0] * n  # the filters of earlier steps
        self.visited, self.since = 1, np.zeros(n, np.int64)
        self.shapley = np.zeros(n, np.int64)
        for i in range(n):
            self._count(i, int(bits[:i].sum()))

    def _count(self, i: int, before: int) -> None:
        bit = 1 << self.order[i]
        here = (self.mask & (before | bit)) == bit
        self.before[i] = before
        self.removed[i] = self.counts[:, here].sum(1)
        self.kept[i] = self.counts[0, (self.mask & (before | bit)) == 0].sum()

    def _settle(self, i: int) -> None:
        """Put the filter at step i into the totals, for the orders since it last changed."""
        f = self.order[i]
        self.shapley[f] += self.removed[i, 0] * (self.visited - self.since[f])
        self.since[f] = self.visited

    def swap(self, i: int) -> None:
        """Go to the order in which steps i and i + 1 are exchanged."""
        self._settle(i)
        self._settle(i + 1)
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        self._count(i, self.before[i])
        self._count(i + 1, self.before[i] | 1 << self.order[i])
        self.visited += 1

    def steps(self, names: str) -> list[tuple]:
        """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of each step."""
        order = "".join(names[f] for f in self.order)
        out = []
        for i, f in enumerate(self.order):
            n, good, toxic = self.removed[i].tolist()
            out.append((order, i + 1, int(self.kept[i]), n, int(self.fails[f]) - n, int(self.alone[f]), good, toxic))
        return out

    def totals(self) -> np.ndarray:
        """Rows removed by each filter, summed over the orders visited."""
        for i in range(self.n):
            self._settle(i)
        return self.shapley


_STEP = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def all_orders(cells: list[tuple[int, int, int, int]], names: str = FILTERS) -> list[tuple]:
    """The steps of all orders over cells (mask, n, good, toxic), with the filter's Shapley total."""
    table = np.array(cells, np.int64).reshape(-1, 4)
    walk = Walk(len(names), table[:, 0], table[:, 1:].T)
    rows = walk.steps(names)
    for i in transpositions(len(names)):
        walk.swap(i)
        rows += walk.steps(names)
    total = walk.totals()
    return [(*r, int(total[names.index(r[0][r[1] - 1])])) for r in rows]


def audit_orders(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    cells: part, mask, n, good, toxic. A part is one row of at most 2**n cells, so parts are independent; cells of one
    mask may repeat; no cells give no rows.
    """
    if not 1 <= len(names) <= MOST:
        raise ValueError(f"1 to {MOST} filters, not {len(names)}")
    parts = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    out = T._parse_datatype_string(f"part string, {_STEP}")
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                rows = all_orders([(c["mask"], c["n"], c["good"], c["toxic"]) for c in held], names)
                columns = [[part] * len(rows), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=out.names)

    return parts.mapInArrow(run, out)


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of filters A to E over whole texts, 600 rows a part; an empty table gives none, and other columns are not read."""
    return audit_orders(mask_cells(document_masks(docs, key, text, part), labels))
