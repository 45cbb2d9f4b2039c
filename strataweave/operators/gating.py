"""A gate over several runs: two small networks over all experts' logits, trained in numpy on a bounded sample.

The row gate is a softmax over the ``top_k`` best experts of a row; the class gate a softmax over the
experts of each class. Half of each mixes the logits. A penalty keeps the gate's mean use of the experts even.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.numeric import finite

#: rows that the gate may be fitted on at most: those with the smallest seeded hashes
MAX_ROWS = 200_000
#: score of an expert that is not among the best
OFF = -1e9


def stacked(experts: dict[str, DataFrame], n_classes: int) -> DataFrame:
    """(row_id, x, y): all experts' logits of a row, by expert and class, cleaned; and its labels. experts: row_id, cls, logit, y on the whole grid."""
    parts = None
    for i, run in enumerate(experts.values()):
        part = run.select("row_id", "y", (F.col("cls") + i * n_classes).alias("at"), finite(F.col("logit")).alias("logit"))
        parts = part if parts is None else parts.unionByName(part)
    listed = F.array_sort(F.collect_list(F.struct("at", "logit", "y")))
    grouped = parts.groupBy("row_id").agg(listed.alias("l"))
    wide = len(experts) * n_classes
    whole = F.when(F.size("l") != wide, F.raise_error(F.concat(F.lit("logits are missing for row "), F.col("row_id").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return grouped.where(whole).select("row_id", F.transform("l", lambda s: s["logit"]).alias("x"), F.transform(F.slice("l", 1, n_classes), lambda s: s["y"].cast("double")).alias("y"))


@dataclass
class Gate:
    """Weights of both networks; ``forward`` gives the mixed logits and the row gate."""

    row: list[np.ndarray]
    cls: list[np.ndarray]
    n_experts: int
    n_classes: int
    top_k: int

    def _run(self, x: np.ndarray, weights: list[np.ndarray], drop: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Input and every layer's output; ``drop`` masks the hidden ones."""
        out = [x]
        for i in range(0, len(weights), 2):
            z = out[-1] @ weights[i] + weights[i + 1]
            if i + 2 < len(weights):
                z = np.maximum(z, 0)
                if drop is not None:
                    z = z * drop[i // 2]
            out.append(z)
        return out

    def weights(self, scores: np.ndarray) -> np.ndarray:
        """Softmax over the best ``top_k`` scores of each row; ties take the first experts."""
        order = np.argsort(-scores, axis=1, kind="stable")
        masked = np.full_like(scores, OFF)
        rows = np.arange(len(scores))[:, None]
        best = order[:, : self.top_k]
        masked[rows, best] = scores[rows, best]
        return softmax(masked, 1)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        experts = x.reshape(-1, self.n_experts, self.n_classes)
        g = self.weights(self._run(x, self.row)[-1])
        c = softmax(self._run(x, self.cls)[-1].reshape(experts.shape), 1)
        return 0.5 * ((g[:, :, None] + c) * experts).sum(1), g


def softmax(z: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(z - z.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def _softmax_back(p: np.ndarray, d: np.ndarray, axis: int) -> np.ndarray:
    return p * (d - (d * p).sum(axis, keepdims=True))


def new_gate(n_experts: int, n_classes: int, hidden: int, top_k: int, rng: np.random.Generator) -> Gate:
    wide = n_experts * n_classes

    def layers(*sizes: int) -> list[np.ndarray]:
        out = []
        for a, b in zip(sizes, sizes[1:], strict=False):
            edge = 1 / np.sqrt(a)
            out += [rng.uniform(-edge, edge, (a, b)), rng.uniform(-edge, edge, b)]
        return out

    return Gate(layers(wide, hidden, max(1, hidden // 2), n_experts), layers(wide, hidden, wide), n_experts, n_classes, min(top_k, n_experts))


def _step(gate: Gate, x: np.ndarray, y: np.ndarray, even: float, drop: float, rng: np.random.Generator) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients of one batch."""
    masks = [[(rng.random((len(x), w.shape[1])) >= drop) / (1 - drop) for w in net[:-2:2]] for net in (gate.row, gate.cls)]
    experts = x.reshape(-1, gate.n_experts, gate.n_classes)
    a, b = gate._run(x, gate.row, masks[0]), gate._run(x, gate.cls, masks[1])
    g = gate.weights(a[-1])
    c = softmax(b[-1].reshape(experts.shape), 1)
    out = 0.5 * ((g[:, :, None] + c) * experts).sum(1)
    p = 1 / (1 + np.exp(-np.clip(out, -60, 60)))
    usage = np.maximum(g.mean(0), 1e-8)
    target = 1 / gate.n_experts
    loss = float((np.logaddexp(0, out) - y * out).mean() + even * (target * (np.log(target) - np.log(usage))).sum() / gate.n_experts)
    d_out = (p - y) / out.size
    d_g = 0.5 * (d_out[:, None, :] * experts).sum(2) - even * target / usage / gate.n_experts / len(x)
    d_c = 0.5 * d_out[:, None, :] * experts
    ends = [_softmax_back(g, d_g, 1), _softmax_back(c, d_c, 1).reshape(len(x), -1)]
    grads: list[np.ndarray] = []
    for net, outs, d, mask in zip((gate.row, gate.cls), (a, b), ends, masks, strict=True):
        back: list[np.ndarray] = []
        for i in range(len(net) - 2, -1, -2):
            back = [outs[i // 2].T @ d, d.sum(0), *back]
            if i:
                d = (d @ net[i].T) * mask[i // 2 - 1] * (outs[i // 2] > 0)
        grads += back
    return loss, grads


def macro_ap(y: np.ndarray, score: np.ndarray) -> float:
    """Mean over classes with a positive of the average precision over distinct scores."""
    out = []
    for k in range(y.shape[1]):
        if not (total := y[:, k].sum()):
            continue
        order = np.argsort(-score[:, k], kind="stable")
        s, hit = score[order, k], np.cumsum(y[order, k])
        last = np.flatnonzero(np.append(s[1:] != s[:-1], True))
        tp = np.diff(np.append(0, hit[last]))
        out.append(float((tp * hit[last] / (last + 1)).sum() / total))
    return float(np.mean(out)) if out else 0.0


def fit_gate(train: tuple[np.ndarray, np.ndarray], val: tuple[np.ndarray, np.ndarray], n_experts: int, hidden: int = 512, epochs: int = 50, rate: float = 3e-4, batch: int = 64, top_k: int = 4, even: float = 0.5, patience: int = 8, seed: int = 42) -> tuple[Gate, float]:
    """The gate with the best macro average precision on val, and that. AdamW with a cosine schedule, gradients clipped to length 1."""
    rng = np.random.default_rng(seed)
    x, y = train
    gate = new_gate(n_experts, y.shape[1], hidden, top_k, rng)
    params = [*gate.row, *gate.cls]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    best, kept, bad, t = -1.0, [p.copy() for p in params], 0, 0
    for epoch in range(epochs):
        now = 0.5 * rate * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            at = order[i : i + batch]
            loss, grads = _step(gate, x[at], y[at], even, 0.1, rng)
            if not np.isfinite(loss):
                continue
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            t += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g * min(1.0, 1 / (norm + 1e-6))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (0.01 * p + (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
        score = macro_ap(val[1], gate.forward(val[0])[0])
        if score > best:
            best, kept, bad = score, [p.copy() for p in params], 0
        else:
            bad += 1
            if bad >= patience:
                break
    for p, k in zip(params, kept, strict=True):
        p[...] = k
    return gate, best


def bounded_sample(rows: DataFrame, seed: int = 42, most: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of at most ``most`` rows, those with the smallest seeded hashes, in row order."""
    got = rows.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(most).toPandas().sort_values("row_id")
    flat = lambda c: np.array(got[c].tolist(), float) if len(got) else np.zeros((0, 0))
    return flat("x"), flat("y")


def apply_gate(rows: DataFrame, gate: Gate, names: list[str]) -> DataFrame:
    """(row_id, logits, usage by expert name) of stacked rows; rows are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                mixed, use = gate.forward(x)
                yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(mixed.tolist(), pa.list_(pa.float64())), pa.array(use.tolist(), pa.list_(pa.float64()))], names=["row_id", "logits", "usage"])

    out = rows.select("row_id", "x").mapInArrow(run, "row_id long, logits array<double>, usage array<double>")
    return out.withColumn("usage", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col("usage")))


def usage(gate: DataFrame, weight: str = "weight") -> DataFrame:
    """(expert, usage): mean weight of each expert over rows (row_id, expert, weight)."""
    return gate.groupBy("expert").agg(F.avg(weight).alias("usage"))


def long_logits(mixed: DataFrame, logits: str | Column = "logits") -> DataFrame:
    """(row_id, cls, logit) of rows with an array of logits."""
    return mixed.select("row_id", F.posexplode(logits).alias("cls", "logit"))
