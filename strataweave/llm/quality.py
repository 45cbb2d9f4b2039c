r"""Quality rules: gradient-boosted trees over document statistics.

The statistics are vectorised over the raw bytes of a batch; words and lines are told apart by their bytes. The trees are
grown on the driver over a bounded sample of labelled rows (logistic loss,
histogram splits, monotonic constraints), then flattened into numpy node arrays
that score a whole batch with one gather per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.llm.textblocks import _NONSPACE, Words, code_pairs, gram_codes, inside, pieces, strings, trimmed

#: characters counted by n_symbols (fixed values)
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "punct_rate", "distinct_rate", "line_words", "top_word_rate", "stop_rate"]
#: 1: a higher value never lowers the score; -1: never raises it; 0: free
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "distinct_rate": 1}
#: labelled rows that the trees may be grown on at most
MAX_LABELLED = 20_000
THRESHOLD = 0.5

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80


def _counts(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _by_text(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (text, key) together, stable, and flags of first places of each run in it."""
    joint = code_pairs(keys, owner, int(owner.max()) + 1 if len(owner) else 1)
    order = np.argsort(joint, kind="stable")
    j = joint[order]
    first = np.ones(len(j), bool)
    first[1:] = j[1:] != j[:-1]
    return order, first


def document_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts and the features of each text of a column without nulls."""
    w = Words(column)
    n, buf, off = w.count, w.buf, w.off
    word = _NONSPACE[buf]
    heads = _HEAD[buf]
    chars = _counts(heads & word, off)
    symbols = _counts(_IS_SYMBOL[buf], off)
    codes, owner = w.codes()[0], w.owner()

    # lines: \n-split; those without a word don't count
    cut = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([off[:-1], cut + 1]))
    starts = starts[starts < len(buf)]
    text_of = np.searchsorted(off, starts, "right") - 1
    ends = np.minimum(np.append(cut, len(buf))[np.searchsorted(cut, starts)], off[text_of + 1])
    worded = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, text_of = starts[worded], ends[worded], text_of[worded]
    order, first = _by_text(text_of, w.range_codes(starts, ends)[0])
    dup_lines = np.bincount(text_of[order][~first], minlength=w.n)
    n_lines = np.bincount(text_of, minlength=w.n)

    # words in 3-word windows found at least twice in the text
    at = inside(n, w.ptr, 3)
    repeated = np.zeros(len(codes) + 3, bool)
    if len(at):
        order, first = _by_text(owner[at], gram_codes(codes, 3)[at])
        run = np.cumsum(first) - 1
        twice = at[order[np.bincount(run)[run] > 1]]
        for j in range(3):
            repeated[twice + j] = True
    repeat_words = _counts(repeated[: len(codes)], w.ptr)

    order, first = _by_text(owner, codes)
    distinct = np.bincount(owner[order][first], minlength=w.n)
    top = np.zeros(w.n, np.int64)
    if len(order):
        np.maximum.at(top, owner[order][first], np.diff(np.append(np.flatnonzero(first), len(first))))
    some, long = np.maximum(n, 1), np.maximum(_counts(heads, off), 1)
    upper = _counts((buf >= 65) & (buf <= 90), off)
    digits = _counts((buf >= 48) & (buf <= 57), off)
    punct = _counts(((buf >= 33) & (buf <= 47)) | ((buf >= 58) & (buf <= 64)) | ((buf >= 91) & (buf <= 96)) | ((buf >= 123) & (buf <= 126)), off)
    short = _counts((w.end - w.start) <= 3, w.ptr)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
        "log_words": np.log1p(n), "mean_word": chars / some, "symbol_rate": symbols / long, "dup_line_rate": dup_lines / np.maximum(n_lines, 1), "repeat_rate": repeat_words / some,
        "upper_rate": upper / long, "digit_rate": digits / long, "punct_rate": punct / long, "distinct_rate": distinct / some, "line_words": n / np.maximum(n_lines, 1), "top_word_rate": top / some, "stop_rate": short / some,
    }


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass
class Trees:
    """Boosted trees as flat arrays. Leaves point at themselves, so ``depth`` steps reach one from any root."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values for each row of x (rows, features)."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8) -> Trees:
    """Boost by second-order gain over quantile bins.

    A split on a constrained feature is taken only if its leaf values stand in the
    right order, and their midpoint bounds both subtrees, so the whole score is
    monotone in that feature. Equal gains: first feature, lowest bin.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)] if n else [np.zeros(0)] * m
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1) if n else np.zeros((0, m), int)
    rate_of = (y.sum() + 1) / (n + 2)
    bias = float(np.log(rate_of / (1 - rate_of)))
    nodes: list[list[float]] = []
    roots = []
    margin = np.full(n, bias)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), rate * value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        if level == depth or len(rows) < 2 * least:
            margin[rows] += rate * value
            return leaf(value)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-9, -1, -1, 0.0, 0.0)
        for j in range(m):
            if not len(edges[j]):
                continue
            b, k = binned[rows, j], len(edges[j]) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, weights=v, minlength=k))[:-1] for v in (g[rows], h[rows], None))
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
            loss = lambda v, a, c: a * v + 0.5 * (c + l2) * v * v
            gain = loss(value, gs, hs) - loss(vl, gl, hl) - loss(vr, gs - gl, hs - hl)
            gain[(nl < least) | (len(rows) - nl < least) | (monotone[j] * (vr - vl) < 0)] = -np.inf
            if (i := int(np.argmax(gain))) >= 0 and gain[i] > best[0] + 1e-12:
                best = (gain[i], j, i, vl[i], vr[i])
        _, j, i, vl, vr = best
        if j < 0:
            margin[rows] += rate * value
            return leaf(value)
        me = len(nodes)
        nodes.append([j, edges[j][i], 0, 0, 0])
        go = binned[rows, j] <= i
        mid = (vl + vr) / 2
        lows, highs = ((low, mid), (mid, high)) if monotone[j] > 0 else ((mid, high), (low, mid)) if monotone[j] < 0 else ((low, high), (low, high))
        nodes[me][2] = grow(rows[go], g, h, level + 1, *lows)
        nodes[me][3] = grow(rows[~go], g, h, level + 1, *highs)
        return me

    for _ in range(n_trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
    a = np.array(nodes, float).reshape(-1, 5)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots, int), depth, bias)


def matrix(s: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(s[f], float) for f in FEATURES], 1) if len(s["n_words"]) else np.zeros((0, len(FEATURES)))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, seed: int = 17) -> DataFrame:
    """(doc_id, text, quality): at most ``max_rows`` labelled documents, the smallest seeded hashes of doc_id.

    The ids are chosen among the labels first, so only chosen rows of docs are
    joined. Rows with a null id or label are left out; of contradicting labels of one
    document the lowest counts, of several texts of one id the least, so reruns agree.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    # chosen has at most max_rows rows of 12 bytes: a proven bound for the broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, **how) -> Trees:
    """Grow the trees on the labelled sample; without two classes they have no tree and score by the base rate, which is 0.5 without rows."""
    got = _with_stats(labelled_sample(docs, labels, max_rows), ["doc_id", "quality"]).select("doc_id", "quality", *FEATURES).toPandas().sort_values("doc_id")
    return grow_trees(got[FEATURES].to_numpy(float), got["quality"].to_numpy(float).clip(0, 1), np.array([MONOTONE.get(f, 0) for f in FEATURES]), **how)


def _with_stats(docs: DataFrame, keep: list[str], trees: Trees | None = None, threshold: float = THRESHOLD) -> DataFrame:
    out = [T.StructField(c, T.LongType()) for c in STATS] + [T.StructField(c, T.DoubleType()) for c in FEATURES]
    if trees is not None:
        out += [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    names = [f.name for f in out]
    keep = [c for c in keep if c not in names]
    need = list(dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            s = document_stats(strings(batch.column("text")))
            if trees is not None:
                s["base_failed"] = base_failed(s)
                s["score"] = trees.score(matrix(s))
                s["kept"] = ~s["base_failed"] & (s["score"] >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(s[f.name], T_ARROW[f.dataType.typeName()]) for f in out], names=keep + names)

    return docs.select(*need).mapInArrow(trimmed(run), T.StructType([docs.schema[c] for c in keep] + out))


T_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def quality_rules(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs (default: all), the base counts, the features, base_failed, score and kept.

    Null and empty texts have no words and fail the base rule. Repeated rows give
    equal verdicts; an empty table gives none; columns named like an output are
    replaced. Rows are independent: no shuffle.
    """
    return _with_stats(docs, keep if keep is not None else docs.columns, trees, threshold)
