"""Logistic regression of many classes and penalties at once, over sparse rows.

One weight matrix holds a column for each pair of class and C. Columns are fitted together by Newton steps: a step's direction comes from
conjugate gradients, its length from a line search, and each of these passes is one job over the rows for all columns that
are still open. So the number of passes is that of the slowest column, however many classes there are. Tasks hold the matrix
and add up what they find by features; blocks of features are summed apart before they reach the driver.

The objective of a column is |w|^2 / 2 + C sum a_i log(1 + exp(-y_i w x_i)), with weights a_i that balance the two
outcomes. The intercept is a feature that is always 1; it is in the penalty or not (``penalize_intercept``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.session import materialize, ship

#: cells of a weight matrix that is fitted at once: columns beyond it are fitted in further matrices
CELLS = 8_000_000
#: stored values of rows that are multiplied at a time; features in a block of a sum
VALUES, FEATURES = 1 << 16, 1 << 14
STEPS = 8


@dataclass
class Linear:
    """Weights (features and intercept, columns) for pairs of class and C; columns of classes without both outcomes are 0."""

    classes: list[int]
    grid: tuple[float, ...]
    weights: np.ndarray
    passes: int = 0

    def column(self, cls: int, c: float) -> np.ndarray:
        return self.weights[:, self.classes.index(cls) * len(self.grid) + self.grid.index(c)]


class _Rows:
    """Some rows: products with a matrix, and with its transpose, a column at a time (sums without sorting)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, off: np.ndarray):
        self.ids, self.values, self.off = ids, values, off
        self.n = np.diff(off)

    def times(self, w: np.ndarray) -> np.ndarray:
        """Rows times w; its last row is the intercept's."""
        out = np.broadcast_to(w[-1], (len(self.n), w.shape[1])).copy()
        some = np.flatnonzero(self.n)
        if len(some):
            for k in range(w.shape[1]):
                out[some, k] += np.add.reduceat(self.values * np.ascontiguousarray(w[:, k])[self.ids], self.off[some])
        return out

    def add_transposed(self, r: np.ndarray, total: np.ndarray) -> None:
        """Add the rows' transpose times r to total."""
        total[-1] += r.sum(0)
        if len(self.ids):
            top = int(self.ids.max()) + 1
            for k in range(r.shape[1]):
                total[:top, k] += np.bincount(self.ids, self.values * np.repeat(r[:, k], self.n), top)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Rows, pa.RecordBatch]]:
    for batch in batches:
        lists = batch.column("ids")
        off = np.asarray(lists.offsets, np.int64)
        ids, values = np.asarray(lists.values, np.int64), np.asarray(batch.column("values").values, float)
        begin = np.asarray(batch.column("values").offsets, np.int64)[0] - off[0]
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + VALUES, "right")) - 1)
            yield _Rows(ids[off[i] : off[j]], values[off[i] + begin : off[j] + begin], off[i : j + 1] - off[i]), batch.slice(i, j - i)
            i = j


#: a block of rows as bytes: what each pass reads needs no list to be taken apart
PACKED = "n long, pos array<long>, sizes binary, ids binary, vals binary, has binary"


def _packed(rows: DataFrame, classes: list[int]) -> DataFrame:
    """Blocks of rows (labels, ids, values): their number, how many have each class, and the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, batch in _chunks(batches):
            has = outcomes(batch.column("labels"), classes) > 0
            blobs = [rows.n.astype(np.int32), rows.ids.astype(np.int32), np.ascontiguousarray(rows.values), has.astype(np.int8)]
            yield pa.RecordBatch.from_arrays([pa.array([len(has)], pa.int64()), pa.array([has.sum(0).tolist()], pa.list_(pa.int64())), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["n", "pos", "sizes", "ids", "vals", "has"])

    return rows.select("labels", "ids", "values").mapInArrow(run, PACKED)


def _unpacked(batches: Iterator[pa.RecordBatch], n_classes: int) -> Iterator[tuple[_Rows, np.ndarray]]:
    """The blocks of a batch at once, with (rows, classes): 1 or -1."""
    for batch in batches:
        if batch.num_rows:
            sizes, ids, values, has = (np.concatenate([np.frombuffer(b.as_buffer(), t) for b in batch.column(c)]) for c, t in (("sizes", np.int32), ("ids", np.int32), ("vals", float), ("has", np.int8)))
            yield _Rows(ids.astype(np.int64), values, np.append(0, np.cumsum(sizes, dtype=np.int64))), np.where(has.reshape(-1, n_classes) > 0, 1.0, -1.0)


def outcomes(labels: pa.Array, classes: list[int]) -> np.ndarray:
    """(rows, classes): 1 where the row has the class, else -1."""
    off = np.asarray(labels.offsets, np.int64)
    flat = np.asarray(labels.values, np.int64)[off[0] : off[-1]]
    at = np.searchsorted(classes, flat)
    known = at < len(classes)
    known[known] = np.asarray(classes)[at[known]] == flat[known]
    out = np.full((len(labels), len(classes)), -1.0)
    out[np.repeat(np.arange(len(labels)), np.diff(off))[known], at[known]] = 1.0
    return out


class _Fit:
    """Columns of one matrix over the rows of a table; ``of`` is the class of each column, ``c`` its C."""

    def __init__(self, rows: DataFrame, size: int, classes: list[int], of: np.ndarray, c: np.ndarray, balance: np.ndarray, penalty: np.ndarray):
        self.rows, self.size, self.classes, self.of, self.c, self.balance, self.penalty = rows, size, classes, of, c, balance, penalty
        self.passes = 0

    def _summed(self, task: Callable, cols: np.ndarray, *matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all rows of what ``task`` adds to a matrix like the weights and to a few numbers for each column."""
        sc = self.rows.sparkSession.sparkContext
        sent = sc.broadcast((self.classes, self.of[cols], self.c[cols], self.balance[:, self.of[cols]], self.size + 1, [m[:, cols] for m in matrices]))
        width = len(cols)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes, of, c, balance, height, held = sent.value
            total, few = np.zeros((height, width)), np.zeros((STEPS, width))
            for rows, y in _unpacked(batches, len(classes)):
                y = y[:, of]
                task(rows, y, np.where(y > 0, balance[1], balance[0]) * c, held, total, few)
            blocks = [(i, total[i : i + FEATURES]) for i in range(0, height, FEATURES)]
            found = [(-1, few)] + [(i, b) for i, b in blocks if b.any()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([b.tobytes() for _, b in found], pa.binary())], names=["block", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                    values = np.frombuffer(sums.as_buffer())
                    if block in held:
                        held[block] += values
                    else:
                        held[block] = values.copy()
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["block", "sums"])

        parts = self.rows.mapInArrow(run, "block int, sums binary").repartition("block").mapInArrow(add, "block int, sums binary").toArrow()
        total, few = np.zeros((self.size + 1, width)), np.zeros((STEPS, width))
        for block, sums in zip(parts.column("block").to_pylist(), parts.column("sums").to_pylist(), strict=True):
            values = np.frombuffer(sums).reshape(-1, width)
            if block < 0:
                few += values
            else:
                total[block : block + len(values)] += values
        sent.destroy()
        self.passes += 1
        return total, few

    def _ridge(self, w: np.ndarray) -> np.ndarray:
        return self.penalty[:, None] * w

    def gradient(self, w: np.ndarray, cols: np.ndarray) -> np.ndarray:
        def task(rows, y, a, held, total, few):
            margin = y * rows.times(held[0])
            rows.add_transposed(-y * a / (1 + np.exp(np.clip(margin, -500, 500))), total)

        return self._summed(task, cols, w)[0] + self._ridge(w[:, cols])

    def curvature(self, w: np.ndarray, v: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """The Hessian at w times v."""

        def task(rows, y, a, held, total, few):
            p = 1 / (1 + np.exp(-np.clip(rows.times(held[0]), -500, 500)))
            rows.add_transposed(a * p * (1 - p) * rows.times(held[1]), total)

        return self._summed(task, cols, w, v)[0] + self._ridge(v[:, cols])

    def along(self, w: np.ndarray, s: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, columns): the objective at w, then at w + s, w + s / 2, w + s / 4 and so on. And the gradient at w + s, the step that is nearly always taken."""

        def task(rows, y, a, held, total, few):
            at, by = y * rows.times(held[0]), y * rows.times(held[1])
            for j in range(STEPS):
                few[j] += (a * np.logaddexp(0, -(at + by * (0.5 ** (j - 1) if j else 0.0)))).sum(0)
            rows.add_transposed(-y * a / (1 + np.exp(np.clip(at + by, -500, 500))), total)

        ahead, losses = self._summed(task, cols, w, s)
        for j in range(STEPS):
            x = w[:, cols] + s[:, cols] * (0.5 ** (j - 1) if j else 0.0)
            losses[j] += 0.5 * (self.penalty[:, None] * x * x).sum(0)
        return losses, ahead + self._ridge(w[:, cols] + s[:, cols])

    def solve(self, rounds: int, tolerance: float, most: int) -> np.ndarray:
        n = len(self.of)
        w = np.zeros((self.size + 1, n))
        live = np.arange(n)
        g = self.gradient(w, live)
        first = np.sqrt((g * g).sum(0))
        for _ in range(rounds):
            norm = np.sqrt((g * g).sum(0))
            live = live[norm[live] > tolerance * np.maximum(first[live], 1e-300)]
            if not len(live):
                return w
            s = self._direction(w, g, live, most, tolerance * first)
            losses, ahead = self.along(w, s, live)
            slope = (g[:, live] * s[:, live]).sum(0)
            step = np.zeros(len(live))
            for j in range(STEPS - 1, 0, -1):  # the longest step that goes down enough
                step = np.where(losses[j] <= losses[0] + 1e-4 * 0.5 ** (j - 1) * slope, 0.5 ** (j - 1), step)
            w[:, live] += step * s[:, live]
            g[:, live] = ahead
            short = live[(step > 0) & (step < 1)]
            if len(short):
                g[:, short] = self.gradient(w, short)
            live = live[step > 0]  # no step goes down: as near as numbers allow
        return w

    def _direction(self, w: np.ndarray, g: np.ndarray, live: np.ndarray, most: int, floor: np.ndarray) -> np.ndarray:
        """Conjugate gradients on Hessian times s = -g, all live columns side by side."""
        s, r = np.zeros_like(g), -g
        p = r.copy()
        rr = (r * r).sum(0)
        norm = np.sqrt(rr)
        target = np.maximum(np.minimum(0.1, np.sqrt(norm / np.maximum(norm.max(), 1e-300))) * norm, 0.3 * floor)
        open_ = live
        for _ in range(most):
            open_ = open_[np.sqrt(rr[open_]) > target[open_]]
            if not len(open_):
                break
            hp = self.curvature(w, p, open_)
            q = p[:, open_]
            alpha = rr[open_] / np.maximum((q * hp).sum(0), 1e-300)
            s[:, open_] += alpha * q
            r[:, open_] -= alpha * hp
            now = (r[:, open_] ** 2).sum(0)
            p[:, open_] = r[:, open_] + now / np.maximum(rr[open_], 1e-300) * q
            rr[open_] = now
        return s


def sparse_rows(rows: DataFrame, weights: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (row_id, ...) with ids and values: their weights (row_id, term, weight) by the number of the term (term, id); rows without any have empty ones."""
    by_row = weights.join(ids, "term").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), F.col("weight").cast("double").alias("weight")))).alias("p"))
    pairs = F.coalesce("p", F.array().cast("array<struct<id:int,weight:double>>"))
    return rows.join(by_row, "row_id", "left").select(*rows.columns, F.transform(pairs, lambda x: x["id"]).alias("ids"), F.transform(pairs, lambda x: x["weight"]).alias("values"))


def dense_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with ids and values from columns of numbers."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.array(*[F.lit(i) for i in range(len(columns))]).alias("ids"), F.array(*[F.col(c).cast("double") for c in columns]).alias("values"))


def fit_linear(train: DataFrame, size: int, classes: list[int], grid: tuple[float, ...], penalize_intercept: bool = True, rounds: int = 40, tolerance: float = 1e-6, most: int = 60, cells: int = CELLS) -> Linear:
    """A column for each class and C over rows (labels, ids, values), ids below ``size``.

    A class that no row has, or all have, gets zeros. The rows are written once, in blocks, and read in each pass; a matrix of more
    than ``cells`` numbers is fitted in parts.
    """
    ship(train.sparkSession)
    classes = sorted(classes)
    held = materialize(_packed(train, classes), "linear")
    n, *pos = held.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", *(F.col("pos")[i] for i in range(len(classes))))]).first()
    held = held.select("sizes", "ids", "vals", "has")
    pos = np.array(pos, float)
    balance = np.stack([n / np.maximum(2 * (n - pos), 1), n / np.maximum(2 * pos, 1)])
    learned = np.flatnonzero((pos > 0) & (pos < n))
    of, c = np.repeat(learned, len(grid)), np.tile(np.array(grid, float), len(learned))
    penalty = np.ones(size + 1)
    penalty[-1] = float(penalize_intercept)
    out, passes = np.zeros((size + 1, len(classes) * len(grid))), 0
    width = max(1, cells // (size + 1))
    for i in range(0, len(of), width):
        part = slice(i, i + width)
        fit = _Fit(held, size, classes, of[part], c[part], balance, penalty)
        out[:, of[part] * len(grid) + (np.arange(len(of))[part] % len(grid))] = fit.solve(rounds, tolerance, most)
        passes += fit.passes
    return Linear(classes, tuple(grid), out, passes)


def linear_logits(model: Linear, rows: DataFrame, grid: tuple[float, ...] | None = None) -> DataFrame:
    """(row_id, c, cls, logit, y) of rows (row_id, labels, ids, values), for each C of ``grid`` (default: all) and each class."""
    ship(rows.sparkSession)
    grid = model.grid if grid is None else grid
    k = len(model.classes)
    at = [j * len(model.grid) + model.grid.index(c) for c in grid for j in range(k)]
    sent = rows.sparkSession.sparkContext.broadcast((model.classes, model.weights[:, at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, w = sent.value
        cls, c = np.tile(np.array(classes, np.int32), len(grid)), np.repeat(np.array(grid, float), k)
        for held, batch in _chunks(batches):
            n = batch.num_rows
            logits, y = held.times(w), outcomes(batch.column("labels"), classes) > 0
            ids = batch.column("row_id").take(pa.array(np.repeat(np.arange(n), len(c))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(c, n)), pa.array(np.tile(cls, n)), pa.array(logits.ravel()), pa.array(np.tile(y, (1, len(grid))).astype(np.int32).ravel())], names=["row_id", "c", "cls", "logit", "y"])

    return rows.select(F.col("row_id").cast("long").alias("row_id"), "labels", "ids", "values").mapInArrow(run, "row_id long, c double, cls int, logit double, y int")


def run_linear(train: DataFrame, val: DataFrame, test: DataFrame, size: int, classes: list[int], scored: DataFrame | None = None, grid: tuple[float, ...] = (0.1, 1.0, 10.0), penalize_intercept: bool = True) -> dict:
    """Fit all classes and C, choose C by macro AP on val over scored classes (of equal ones the first), and give logits of all parts. Rows: row_id, labels, ids, values."""
    from strataweave.operators.metrics import macro_average_precision

    model = fit_linear(train, size, classes, grid, penalize_intercept)
    judged = linear_logits(model, val)
    judged = judged if scored is None else judged.join(scored.select("cls"), "cls", "left_semi")
    ap = {r["c"]: r["macro_ap"] for r in macro_average_precision(judged, ["c"], score="logit").collect()}
    c = max(model.grid, key=lambda x: (ap.get(x, 0.0), -model.grid.index(x)))
    chosen = lambda rows: linear_logits(model, rows, (c,)).drop("c")
    return {"c": c, "val_macro_ap": ap.get(c, 0.0), "model": model, "train": chosen(train), "val": chosen(val), "test": chosen(test)}
