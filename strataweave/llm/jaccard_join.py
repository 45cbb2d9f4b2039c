r"""N-gram Jaccard join by signature trees, and its link components.

Two sets that reach the threshold share a token among the first n - ceil(t n) + 1
of each in any common order, here that of the tokens' hashes (prefix filter). The
prefixes are taken longer by l(n) - 1, so a linked pair shares l tokens of them.
Tokens that many sets have in their prefix are *hot*; a set with fewer than l hot
tokens drops these, as a link of it shows in another token, and all sets that keep
them are those with l or more, so no link is lost. The groups of hot tokens are
split into bands of set size, and hold only plain prefixes.

The sets of each token form a group. Small groups are one leaf, compared in whole;
larger ones are put in a signature tree: nodes hold the OR of their sets' bitmaps,
the range of set sizes and the least number of bits. The tree is traversed against
itself, level by level; node pairs go when their sizes or the largest overlap that
bitmaps and sizes allow rule out a link. What is left is verified on the texts.

Large groups take two rounds: first each set's likeliest pairs in its first few hot groups, verified, give
components (groups of more than ``GROUP`` sets are parted by minhashes for that); then,
in groups of several components, all other pairs of different components are sought, in trees of
wide bitmaps (4 bits for each token; groups of more than ``GROUP`` sets in pairs of blocks),
so nothing hangs on the first choice. So a clique of near copies costs about as many
verifications as it has members, and copies that differ too much are told apart
without their texts. Wide bitmaps of twice the width fold onto narrower ones.

These rounds settle the components only. Links lie within components, so each set's number
of links is counted afterwards among all sets of its component, in pairs of blocks.

Shingles travel as 64-bit hashes under a key that is drawn for the run, so texts made to share hashes don't exist before it;
links are verified on the words.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.identity import RID, given_rows, identified
from strataweave.llm.textblocks import U, Words, code_pairs, gram_hashes, inside, mix, pieces, raw, secret_factor, string_array, strings, trimmed
from strataweave.operators.graph import connected_components
from strataweave.operators.overlaps import overlaps
from strataweave.session import dealt, forget, materialize, shuffle_width

GRAM, PERCENT = 4, 85
#: sets with a token in their prefix from which it is hot
HOT = 64
#: hot tokens of a set, the smallest, that take part in the first round
HOT_FIRST = 3
#: sets in a hot group from which it is parted in the first round and dealt into blocks in the second
GROUP = 2048
#: sets in a group that is one leaf; children of a node of larger ones
LEAF = 16
BITS = 512
#: in the first round: sets after each one that it is compared with in a large group, and how many of these it is paired with
NEAR, NEAREST = 128, 4
#: of the wide bitmap's width, the power of two at most
WIDEST = 17
#: sets in a block of a component whose links are counted, and tokens of all of them (about)
BLOCK, BLOCK_TOKENS = 512, 500_000
_LANES = BITS // 64


def slack(n: np.ndarray) -> np.ndarray:
    """l(n): tokens that linked sets share in their prefixes at least, by the size of the smaller."""
    return 1 + n // 20


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(w: Words, k: int, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keyed hashes, offsets): the distinct k-word shingles of each text, ascending; with fewer words the whole sequence is one."""
    h, factor = w.keyed_hashes(key), secret_factor(key)
    at = inside(w.count, w.ptr, k)
    grams = gram_hashes(h, k, factor)[at] if len(at) else np.zeros(0, U)
    size = np.maximum(w.count - k + 1, 0)
    ends = np.cumsum(size)
    out, n = [], np.zeros(w.n, np.int64)
    for i in range(w.n):
        if size[i]:
            g = np.sort(grams[ends[i] - size[i] : ends[i]])
            g = g[np.append(True, g[1:] != g[:-1])]
        elif w.count[i]:
            g = gram_hashes(h[w.ptr[i] : w.ptr[i + 1]], int(w.count[i]), factor) ^ U(int(w.count[i]))
        else:
            continue
        out.append(g)
        n[i] = len(g)
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate([[0], np.cumsum(n)])


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of the wide bitmap of sets of n tokens: a power of two, about 4 n."""
    power = np.ceil(np.log2(np.maximum(4 * n, BITS))).astype(np.int64)
    return np.left_shift(1, np.minimum(power, WIDEST))


def bitmaps(tokens: np.ndarray, off: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a bitmap for each text; a token's bit is its hash modulo the width."""
    bit = (mix(tokens ^ U(0x5851F42D4C957F2D)) >> U(20)).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    flat = np.zeros(start[-1], bool)
    flat[start[owner] + (bit & (width[owner] - 1))] = True
    return np.packbits(flat, bitorder="little"), start // 8


def fold(bits: np.ndarray, lanes: int) -> np.ndarray:
    """Bitmaps (rows, lanes) at a narrower width."""
    while bits.shape[1] > lanes:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, U)
    np.cumsum(x, out=total[1:])
    return (total[off[1:]] - total[off[:-1]]).view(np.int64)


def _least(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The least value of each text, 0 without any."""
    out = np.zeros(len(off) - 1, U)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.minimum.reduceat(x, off[some])
    return out.view(np.int64)


def _profiles(k: int, percent: int, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            tokens, off = shingle_sets(Words(strings(batch.column("text")), lower=True), k, key)
            n = np.diff(off)
            k1, k2 = _sums(mix(tokens ^ U(1)), off), _sums(mix(tokens ^ U(2)), off)
            rid = np.asarray(batch.column(RID), np.int64)
            # of equal sets in the batch only the smallest id gives tokens
            order = np.lexsort((rid, k2, k1))
            same = np.zeros(len(rid), bool)
            same[order[1:]] = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
            take = np.where(same, 0, np.minimum(n, n - -(-percent * n // 100) + slack(n)))
            at = np.repeat(off[:-1] - (np.cumsum(take) - take), take) + np.arange(take.sum())
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(tokens[at].view(np.int64)))
            maps = [string_array(*bitmaps(tokens, off, width), binary=True) for width in (np.full(len(n), BITS), widths(n))]
            least = [_least(mix(tokens ^ U(seed)), off) for seed in (3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(n), pa.array(k1), pa.array(k2), prefix, *maps, *map(pa.array, least)], names=[RID, "n", "k1", "k2", "prefix", "bitmap", "wide", "m1", "m2"])

    return run


# -- signature trees -----------------------------------------------------------------

def _possible(n_a, pop_a, n_b, pop_b, both, percent: int, least_a, least_b):
    """Whether sizes and bitmaps allow a link: n_* and pop_* are the largest size and fewest bits, both the bits in common."""
    most = np.minimum(n_a - np.maximum(pop_a - both, 0), n_b - np.maximum(pop_b - both, 0))
    return (100 * n_a >= percent * least_b) & (100 * n_b >= percent * least_a) & (most >= least_overlap(least_a, least_b, percent))


class SignatureTree:
    """Nodes over sets sorted by size; level 0 has the sets, each higher level ``LEAF`` nodes in one.

    Pairs of equal labels aren't sought, nor, with ``side``, pairs of one side.
    """

    def __init__(self, n: np.ndarray, bits: np.ndarray, label: np.ndarray | None = None, side: np.ndarray | None = None):
        label = label if label is not None else np.arange(len(n))
        side = side if side is not None else np.arange(len(n))
        self.levels = [(n, n, np.bitwise_count(bits).sum(1, dtype=np.int64), bits, label, label, side, side)]
        while len(self.levels[-1][0]) > 1:
            low, high, pop, b, first, last, left, right = self.levels[-1]
            cut = np.arange(0, len(low), LEAF)
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(pop, cut), np.bitwise_or.reduceat(b, cut), *(f.reduceat(x, cut) for f, x in ((np.minimum, first), (np.maximum, last), (np.minimum, left), (np.maximum, right)))))

    def keep(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs of a level may hold a link that is sought."""
        low, high, pop, bits, *ends = self.levels[level]
        out = np.zeros(len(a), bool)
        for i in range(0, len(a), 65_536):
            x, y = a[i : i + 65_536], b[i : i + 65_536]
            both = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64)
            one = np.zeros(len(x), bool)
            for first, last in (ends[:2], ends[2:]):
                one |= (first[x] == last[y]) & (first[y] == last[x])  # then all four are equal
            out[i : i + 65_536] = _possible(high[x], pop[x], high[y], pop[y], both, percent, low[x], low[y]) & ~one
        return out

    def pairs(self, percent: int, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets that the dual traversal leaves, in blocks: depth first, so that few node pairs are open at a time."""
        size = [len(level[0]) for level in self.levels]
        if size[0] < 2:
            return
        root = np.zeros(1, np.int64)
        stack = [(len(size) - 1, root, root)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                yield a, b
                continue
            if len(a) > block:
                stack.append((level, a[block:], b[block:]))
            level -= 1
            x, y = np.broadcast_arrays((a[:block, None] * LEAF + np.arange(LEAF))[:, :, None], (b[:block, None] * LEAF + np.arange(LEAF))[:, None, :])
            fit = (x < size[level]) & (y < size[level]) & (x < y if level == 0 else x <= y)
            x, y = x[fit], y[fit]
            ok = self.keep(level, x, y, percent)
            if ok.any():
                stack.append((level, x[ok], y[ok]))


def leaf_pairs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within groups of at most ``LEAF`` rows."""
    a, b = [], []
    for c in range(2, LEAF + 1):
        s = start[size == c]
        if len(s):
            i, j = np.triu_indices(c, 1)
            a.append((s[:, None] + i).ravel())
            b.append((s[:, None] + j).ravel())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def likely_pairs(n: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set the ``NEAREST`` most alike of the ``NEAR`` sets after it, in an order that puts alike ones together (two minhashes of the bitmap, then size)."""
    c = len(n)
    rng = np.random.default_rng(9)
    hashes = np.empty((2, c), np.int16)
    for h in hashes:
        places = rng.permutation(BITS).astype(np.int16)
        for i in range(0, c, 4096):
            flags = np.unpackbits(bits[i : i + 4096].view(np.uint8), axis=1)
            h[i : i + 4096] = np.where(flags, places, np.int16(BITS)).min(1)
    order = np.lexsort((n, *hashes[::-1]))
    n, bits = n[order], bits[order]
    pop = np.bitwise_count(bits).sum(1, dtype=np.int64)
    found = []
    for low in range(0, c, 8192):
        rows = np.arange(low, min(c, low + 8192))
        alike = np.full((len(rows), min(NEAR, c - 1)), -1.0)
        for d in range(1, alike.shape[1] + 1):
            x = rows[: max(0, c - d - low)]
            both = np.bitwise_count(bits[x] & bits[x + d]).sum(1, dtype=np.int64)
            ok = _possible(n[x], pop[x], n[x + d], pop[x + d], both, percent, n[x], n[x + d])
            alike[: len(x), d - 1] = np.where(ok, both / np.maximum(pop[x] + pop[x + d] - both, 1), -1.0)
        best = np.argsort(-alike, axis=1, kind="stable")[:, :NEAREST]
        i, j = np.repeat(np.arange(len(rows)), best.shape[1]), best.ravel()
        some = alike[i, j] >= 0
        found.append((rows[i[some]], rows[i[some]] + j[some] + 1))
    return tuple(order[np.concatenate([f[k] for f in found])] for k in range(2))


def _groups(got: list[pa.RecordBatch], names: list[str]) -> tuple[list[np.ndarray], pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, bitmaps, starts and sizes of the token groups of a partition, sorted by token, n and _rid; and that order."""
    t = pa.Table.from_batches(got)
    token, rid, n = (t[c].to_numpy().astype(np.int64) for c in ("token", RID, "n"))
    order = np.lexsort((rid, n, token))
    bits = t["bitmap"].combine_chunks()
    bits = (bits.chunk(0) if isinstance(bits, pa.ChunkedArray) else bits).take(pa.array(order))
    start = np.flatnonzero(np.append(True, np.diff(token[order]) != 0))
    return [t[c].to_numpy().astype(np.int64)[order] for c in names], bits, start, np.diff(np.append(start, len(order))), order


def _pairs_out(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    x, y = (np.concatenate([f[i] for f in found]) for i in range(2))
    order = np.lexsort((np.maximum(x, y), np.minimum(x, y)))
    a, b = np.minimum(x, y)[order], np.maximum(x, y)[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    a, b = a[new], b[new]
    for i in range(0, len(a), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 200_000]), pa.array(b[i : i + 200_000])], names=["a", "b"])


def _batched(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of blocks of at most about ``most`` pairs."""
    block, n = [], 0
    for pair in found:
        block.append(pair)
        n += len(pair[0])
        if n >= most:
            yield from _pairs_out(block)
            block, n = [], 0
    if block:
        yield from _pairs_out(block)


def _first_round(percent: int):
    """All candidates of groups of one leaf, the likely ones of larger groups. Rows: token, own, _rid, n, bitmap."""

    def find(rid, n, own, bits, start, size):
        a, b = leaf_pairs(start, size)
        pop = np.bitwise_count(bits).sum(1, dtype=np.int64)
        for i in range(0, len(a), 65_536):
            x, y = a[i : i + 65_536], b[i : i + 65_536]
            ok = _possible(n[x], pop[x], n[y], pop[y], np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64), percent, n[x], n[y])
            yield rid[x[ok]], rid[y[ok]]
        for s, c in zip(start[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
            if own[s : s + c].any():
                a, b = likely_pairs(n[s : s + c], np.ascontiguousarray(bits[s : s + c]), percent)
                some = (own[s + a] | own[s + b]) > 0
                yield rid[s + a[some]], rid[s + b[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := [b for b in batches if b.num_rows]:
            (rid, n, own), maps, start, size, _ = _groups(got, [RID, "n", "own"])
            yield from _batched(find(rid, n, own, raw(maps)[0].view("<u8").reshape(-1, _LANES), start, size))

    return run


def disjoint(x: np.ndarray, y: np.ndarray, codes: np.ndarray, off: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Which pairs of sets have no code in common; set i holds codes[off[i]:off[i + 1]], each once."""
    size = np.diff(off)
    total = np.cumsum(size[x] + size[y])
    out = np.ones(len(x), bool)
    i = 0
    while i < len(x):  # about so many codes at a time
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + block, "right")))
        sets = np.stack([x[i:j], y[i:j]], 1).ravel()
        n = size[sets]
        at = np.repeat(off[sets] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        joint = np.sort(code_pairs(codes[at], np.repeat(np.arange(j - i).repeat(2), n), j - i))
        out[i + joint[1:][joint[1:] == joint[:-1]] % (j - i)] = False
        i = j
    return out


def _second_round(percent: int):
    """Candidates of different components. Rows: token, own, _rid, n, wide bitmap, component, side, below.

    own is false for sets of the band below: pairs of two of these are found in their own band. side is -1 but in pairs of blocks
    of a large group, where only pairs of both sides are sought. below holds the set's tokens before that of the group: a pair that shares one
    of these is found there, so each pair is put out in one group only.
    """

    def find(rid, n, label, home, side, buf, off, below, start, size):
        lanes = np.diff(off) // 8
        codes, ends = below
        for s, c in zip(start.tolist(), size.tolist(), strict=True):
            if (label[s : s + c] == label[s]).all() or not home[s : s + c].any():
                continue
            # a tree for each width: its own sets, and those of twice the width that are not too large, folded
            for width in np.unique(lanes[s : s + c]):
                own = s + np.flatnonzero(lanes[s : s + c] == width)
                twice = s + np.flatnonzero((lanes[s : s + c] == 2 * width) & (percent * n[s : s + c] <= 100 * n[own].max()))
                row = lambda at, w: buf[off[at][:, None] + np.arange(w * 8)].view("<u8")
                bits = np.concatenate([row(own, width), fold(row(twice, 2 * width), width)]) if len(twice) else row(own, width)
                at = np.concatenate([own, twice])
                order = np.lexsort((rid[at], n[at], side[at]))
                at, bits, mine = at[order], bits[order], (order < len(own))
                across = side[s] >= 0
                for a, b in SignatureTree(n[at], bits, label[at], side[at] if across else None).pairs(percent):
                    some = (mine[a] | mine[b]) & ((home[at[a]] | home[at[b]]) > 0)
                    x, y = at[a[some]], at[b[some]]
                    new = disjoint(x, y, codes, ends)
                    yield rid[x[new]], rid[y[new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        (rid, n, label, home, side), maps, start, size, order = _groups(got, [RID, "n", "component", "own", "side"])
        below = pa.concat_arrays([b.column("below") for b in got]).take(pa.array(order))
        buf, off = raw(maps)
        ends = np.asarray(below.offsets, np.int64)
        codes = np.unique(np.asarray(below.values, np.int64), return_inverse=True)[1]
        yield from _batched(find(rid, n, label, home, side, np.ascontiguousarray(buf), off, (codes, ends), start, size))

    return run


def _screen(percent: int):
    """Pairs that sizes and wide bitmaps allow to be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (np.asarray(batch.column(c), np.int64) for c in ("n_a", "n_b"))
            (buf_a, off_a), (buf_b, off_b) = (raw(strings_or_bytes(batch.column(c))) for c in ("wide_a", "wide_b"))
            ok = np.zeros(batch.num_rows, bool)
            wide_a, wide_b = np.diff(off_a) // 8, np.diff(off_b) // 8
            # pairs of equal widths at once, some at a time
            for u, v in {*zip(wide_a.tolist(), wide_b.tolist(), strict=True)}:
                same = np.flatnonzero((wide_a == u) & (wide_b == v))
                step = max(1, (4 << 20) // (8 * (u + v)))
                for at in (same[i : i + step] for i in range(0, len(same), step)):
                    x = fold(buf_a[off_a[at][:, None] + np.arange(8 * u)].view("<u8"), min(u, v))
                    y = fold(buf_b[off_b[at][:, None] + np.arange(8 * v)].view("<u8"), min(u, v))
                    p, q, both = (np.bitwise_count(z).sum(1, dtype=np.int64) for z in (x, y, x & y))
                    ok[at] = _possible(n_a[at], p, n_b[at], q, both, percent, n_a[at], n_b[at])
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return run


def strings_or_bytes(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def screened(pairs: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the wide bitmaps don't rule out."""
    side = lambda end: profile.select(F.col(RID).alias(end), F.col("n").alias(f"n_{end}"), F.col("wide").alias(f"wide_{end}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(trimmed(_screen(percent)), "a long, b long")


def _verify(k: int, percent: int):
    """The pairs that reach the threshold, by the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_a", 1 << 20):
            # a text that is in several pairs of the batch is cut once
            rid = np.concatenate([np.asarray(batch.column(c)) for c in ("a", "b")])
            _, first, at = np.unique(rid, return_index=True, return_inverse=True)
            texts = pa.concat_arrays([strings(batch.column(c)) for c in ("text_a", "text_b")])
            codes, off = Words(texts.take(pa.array(first)), lower=True).gram_sets(k)
            ia, ib = at[: batch.num_rows], at[batch.num_rows :]
            both = np.array([len(np.intersect1d(codes[off[i] : off[i + 1]], codes[off[j] : off[j + 1]], assume_unique=True)) for i, j in zip(ia, ib, strict=True)], np.int64)
            union = np.diff(off)[ia] + np.diff(off)[ib] - both
            ok = (100 * both >= percent * union) & (union > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), pa.array(both[ok]), pa.array(union[ok])], names=["a", "b", "both", "either"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, k: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(a, b, both, either): the pairs that reach the threshold on whole texts, with sizes of intersection and union."""
    left = docs.select(F.col(RID).alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col(RID).alias("b"), F.col("text").alias("text_b"))
    return left.join(pairs, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(trimmed(_verify(k, percent)), "a long, b long, both long, either long")


def _links(pairs: DataFrame, profile: DataFrame, docs: DataFrame, k: int, percent: int, width: int = 0) -> DataFrame:
    """Verified links among candidate pairs, by stages that are written, so that shuffle files go after each."""
    distinct = materialize(pairs.distinct(), "pairs", width)
    left = materialize(screened(distinct, profile, percent), "pairs", width)
    forget(distinct)
    links = materialize(verified(left, docs, k, percent), "links", width)
    forget(left)
    return links


# -- numbers of links ----------------------------------------------------------------


def packed(sets: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    """Sets of a block: their distinct tokens once, each set's size, and which tokens it has as bits or numbers, whichever is shorter."""
    size = np.array([len(x) for x in sets], np.int64)
    tokens, codes = np.unique(np.concatenate(sets) if sets else np.zeros(0, U), return_inverse=True)
    if len(sets) * len(tokens) < 32 * len(codes):
        has = np.zeros((len(sets), len(tokens)), bool)
        has[np.repeat(np.arange(len(sets)), size), codes] = True
        return tokens.tobytes(), size.tobytes(), b"b" + np.packbits(has).tobytes()
    return tokens.tobytes(), size.tobytes(), b"n" + codes.astype("<u4").tobytes()


def unpacked(tokens: bytes, size: bytes, held: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets) of ``packed`` sets."""
    tokens, size = np.frombuffer(tokens, U), np.frombuffer(size, np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    if held[:1] == b"n":
        return tokens[np.frombuffer(held, "<u4", offset=1)], off
    has = np.unpackbits(np.frombuffer(held, np.uint8, offset=1), count=len(size) * len(tokens)).reshape(len(size), len(tokens))
    return tokens[np.nonzero(has)[1]], off


def _linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a and b (tokens, offsets) link."""
    both = overlaps(*a, *b)
    return 100 * both >= percent * (np.diff(a[1])[:, None] + np.diff(b[1]) - both)


def _pack_blocks(k: int, percent: int, key: bytes):
    """A row for each block, with each set's links within it, and its sets packed where the component has other blocks. Rows, sorted by component and own: component, own, many, _rid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def done() -> pa.RecordBatch:
            rids, sets = zip(*held, strict=True)
            off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            flat = (np.concatenate(sets), off)
            linked = _linked(flat, flat, percent)
            np.fill_diagonal(linked, False)
            blob = packed(list(sets)) if last[2] else (None, None, None)
            columns = [[last[0]], [last[1]], [list(rids)], [linked.sum(1).tolist()], *([x] for x in blob)]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["component", "own", "rids", "links", "tokens", "sizes", "held"])

        for batch in pieces(batches):
            tokens, off = shingle_sets(Words(strings(batch.column("text")), lower=True), k, key)
            for i, (component, own, many, rid) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("component", "own", "many", RID)), strict=True)):
                if last != (component, own, many):
                    if held:
                        yield done()
                    last, held = (component, own, many), []
                held.append((rid, tokens[off[i] : off[i + 1]].copy()))
        if held:
            yield done()

    return run


def _count_across(percent: int):
    """(rids, links) of the sets of two blocks with those of the other. Rows, sorted by component and pair: component, lower, upper, rids, tokens, sizes, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            for row in batch.to_pylist():
                pair = (row["component"], row["lower"], row["upper"])
                block = (row["rids"], unpacked(row["tokens"], row["sizes"], row["held"]))
                if first is None or first[0] != pair:
                    first = (pair, block)  # a block whose partner is not there meets none
                    continue
                linked = _linked(first[1][1], block[1], percent)
                yield pa.RecordBatch.from_arrays([pa.array([first[1][0], block[0]], pa.list_(pa.int64())), pa.array([linked.sum(1).tolist(), linked.sum(0).tolist()], pa.list_(pa.int64()))], names=["rids", "links"])
                first = None

    return run


def link_counts(classes: DataFrame, profile: DataFrame, docs: DataFrame, k: int, percent: int, key: bytes) -> DataFrame:
    """(_rep, n_links): for each set of a component (node, component) its links among all sets of it.

    Large components are dealt into blocks by size band, and the bands' sets by hash. A block's texts are cut once; it is written with its
    distinct tokens, which near copies share, and goes to each block of its own band and of the next ones, as sizes of a link are at most one band apart.
    """
    band = F.floor(F.log("n") / math.log(100 / (percent - 1)))
    nodes = classes.withColumnRenamed("node", RID).join(profile.select(RID, "n"), RID).select(RID, "component", "n", band.alias("band"))
    bands = nodes.groupBy("component", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK, F.col("tokens") / BLOCK_TOKENS))
    whole = bands.groupBy("component").agg(F.sum("sets").alias("sets"), F.sum("tokens").alias("tokens"), F.map_from_entries(F.collect_list(F.struct("band", blocks.alias("blocks")))).alias("blocks"))
    placed = materialize(nodes.join(whole, "component"), "placed")
    two = placed.where("sets = 2").select(F.col(RID).alias("_rep"), F.lit(1).cast("long").alias("n_links"))

    number = lambda b: F.coalesce(F.try_element_at("blocks", b), F.lit(0).cast("long"))
    at = lambda b: F.when(number(b) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(number(b) - 1, F.lit(0))), lambda h: b * (1 << 32) + h)).otherwise(F.array().cast("array<long>"))
    here, many = F.col("band"), (F.col("sets") > BLOCK) | (F.col("tokens") > BLOCK_TOKENS)
    own = F.when(many, here * (1 << 32) + F.pmod(F.xxhash64(RID), number(here))).otherwise(F.lit(0).cast("long"))
    key_of = ["component", "own"]
    dealt_out = placed.where("sets > 2").select("component", own.alias("own"), many.alias("many"), RID).join(docs.select(RID, "text"), RID)
    packed_blocks = dealt_out.repartition(*key_of).sortWithinPartitions(*key_of).select(*key_of, "many", RID, "text").mapInArrow(trimmed(_pack_blocks(k, percent, key)), "component long, own long, rids array<long>, links array<long>, tokens binary, sizes binary, held binary")
    packed_blocks = materialize(packed_blocks, "packed")
    others = F.filter(F.concat(at(here - 1), at(here), at(here + 1)), lambda x: x != F.col("own"))
    partners = packed_blocks.where("held is not null").withColumn("band", F.floor(F.col("own") / (1 << 32))).join(placed.select("component", "blocks").dropDuplicates(["component"]), "component")
    met = partners.withColumn("other", F.explode(others)).select("component", F.least("own", "other").alias("lower"), F.greatest("own", "other").alias("upper"), "rids", "tokens", "sizes", "held")
    pair = ["component", "lower", "upper"]
    across = met.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(trimmed(_count_across(percent)), "rids array<long>, links array<long>")
    counted = packed_blocks.select("rids", "links").unionByName(across).select(F.explode(F.arrays_zip("rids", "links")).alias("x"))
    return counted.groupBy(F.col("x.rids").alias("_rep")).agg(F.sum("x.links").alias("n_links")).unionByName(two)


def _components(marked: DataFrame, k: int, percent: int, hot: int, counted: bool = True, group: int = GROUP, secret: bytes | None = None) -> DataFrame:
    """(_rid, n_shingles, component, and n_links if ``counted``) of documents (_rid, text); component is a _rid."""
    columns = f"{RID} long, n long, k1 long, k2 long, prefix array<long>, bitmap binary, wide binary, m1 long, m2 long"
    width = shuffle_width(marked)
    secret = secret or secrets.token_bytes(16)  # drawn anew for each run: nobody can choose words that share a hash
    profile = materialize(marked.mapInArrow(trimmed(_profiles(k, percent, secret)), columns), "profiles")
    # of equal sets the smallest id stands for all
    sets = materialize(profile.where("n > 0").groupBy("k1", "k2").agg(F.min(RID).alias("_rep")), "sets", width)
    # the plain prefix, without the extension that lets sets drop hot tokens
    core = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    firsts = profile.where("size(prefix) > 0").select(RID, "n", "prefix").join(sets.select(F.col("_rep").alias(RID)), RID, "left_semi")
    tokens = firsts.select(F.posexplode("prefix").alias("i", "token"), RID, core.alias("p")).select("token", RID, (F.col("i") < F.col("p")).alias("core"))
    # counted with a map-side combine, and written: AQE splits a hot token's rows only in a join of plain shuffles
    counts = materialize(tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"), "counts", width)
    shared = tokens.join(counts.hint("shuffle_hash"), "token")
    pick = lambda where: F.collect_list(F.when(where, F.col("token")))
    sets_of = F.col("sets")
    lists = shared.groupBy(RID).agg(pick(sets_of <= LEAF).alias("few"), pick((sets_of > LEAF) & (sets_of < hot)).alias("many"), pick((sets_of >= hot) & F.col("core")).alias("hot"), F.count_if(sets_of >= hot).alias("n_hot"))
    # two sets that both keep hot tokens share one of their plain prefixes
    enough = F.col("n_hot") >= 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 20)
    # a set takes part in its own size band and in the next: sizes of a link are at most one band apart
    band = F.floor(F.log("n") / math.log(100 / (percent - 1)))
    entry = lambda token, own, hot, raw: F.struct(token.alias("token"), F.lit(own).alias("own"), F.lit(hot).alias("hot"), raw.alias("raw"))
    plain = lambda tokens: F.transform(tokens, lambda t: entry(t, 1, False, t))
    banded = lambda tokens: F.flatten(F.transform(tokens, lambda t: F.array(entry(F.xxhash64(t, band), 1, True, t), entry(F.xxhash64(t, band + 1), 0, True, t))))
    kept = F.when(enough, F.concat("many", "hot")).otherwise(F.col("many"))
    with_hot = lambda tokens: F.when(enough, F.concat(plain("many"), banded(tokens))).otherwise(plain("many"))
    likely = with_hot(F.slice(F.sort_array("hot"), 1, HOT_FIRST))
    members = materialize(lists.join(profile.select(RID, "n"), RID).select(RID, plain("few").alias("few"), likely.alias("likely"), with_hot(F.col("hot")).alias("many"), kept.alias("kept")).where("size(few) + size(many) > 0"), "members", width)
    forget(counts)

    pairs = "a long, b long"
    # large groups are parted by minhashes, which put alike sets together, twice
    large = materialize(members.select(F.explode("many").alias("t")).where("t.hot").groupBy("t.token").agg(F.count("*").alias("size")).where(F.col("size") > group), "large", width)
    signed = members.join(profile.select(RID, "n", "bitmap", "m1", "m2"), RID).select(F.explode(F.concat("few", "likely")).alias("t"), RID, "n", "bitmap", "m1", "m2").select("t.token", "t.own", RID, "n", "bitmap", "m1", "m2")
    parted = signed.join(large, "token", "left").withColumn("token", F.explode(F.when(F.col("size").isNull(), F.array("token")).otherwise(F.array(F.xxhash64("token", "m1"), F.xxhash64("token", F.lit(2), "m2")))))
    first = dealt(parted.select("token", "own", RID, "n", "bitmap"), width, "token").mapInArrow(trimmed(_first_round(percent)), pairs)
    links = _links(first, profile, marked, k, percent, width)
    classes = materialize(connected_components(links), "classes", width)

    labelled = members.where("size(many) > 0").join(classes.withColumnRenamed("node", RID), RID, "left").select(F.explode("many").alias("t"), RID, F.coalesce("component", RID).alias("component")).select("t.token", "t.own", "t.raw", RID, "component")
    # groups of one component are done; large ones are dealt into blocks, and each block meets each
    ends = materialize(labelled.groupBy("token").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token", F.ceil(F.col("size") / group).alias("blocks")), "ends", width)
    below = F.filter("kept", lambda t: t < F.col("raw"))
    few_left = labelled.join(ends, "token").join(members.select(RID, "kept"), RID)
    open_ = materialize(few_left.select("token", "own", RID, "component", "blocks", below.alias("below")), "open", width)
    block = F.pmod(F.xxhash64(RID, F.lit(5)), F.col("blocks"))
    met = open_.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when((F.col("blocks") == 1) | (F.col("block") == F.col("other")), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
    pair = F.when(F.col("blocks") == 1, F.col("token")).otherwise(F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")))
    sought = met.select(pair.alias("token"), "own", RID, "component", side.alias("side"), "below").join(profile.select(RID, "n", F.col("wide").alias("bitmap")), RID).select("token", "own", RID, "n", "bitmap", "component", "side", "below")
    second = dealt(sought, width, "token").mapInArrow(trimmed(_second_round(percent)), pairs)
    more = _links(second, profile, marked, k, percent, width)
    for done in (members, large, ends, open_):
        forget(done)

    top = materialize(connected_components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b"))), "top", width)
    placed = profile.select(RID, "n", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), "k2").join(sets, ["k1", "k2"], "left").select(RID, F.col("n").alias("n_shingles"), F.coalesce("_rep", RID).alias("_rep"))
    found = placed.join(top.withColumnRenamed("node", "_rep"), "_rep", "left").select(RID, "n_shingles", "_rep", F.coalesce("component", "_rep").alias("component"))
    if not counted:
        return found.drop("_rep")
    degree = materialize(link_counts(top, profile, marked, k, percent, secret), "degrees", width)
    return found.join(degree, "_rep", "left").select(RID, "n_shingles", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = GRAM, percent: int = PERCENT, hot: int = HOT, group: int = GROUP, counted: bool = True) -> DataFrame:
    """(key, n_shingles, component_id, n_links) for every document.

    Sets: distinct k-word shingles of the whole text, A-Z lower-cased; null and empty
    texts have none and link with nothing. component_id is the smallest key reachable
    by links. n_links is the number of other distinct sets that the document's set links
    with, and is left out if not ``counted``. Keys need not be unique (see
    ``identified``): rows that repeat key and text are one document. An empty table
    gives no rows; other columns are not read.
    """
    marked, back = identified(docs.select(key, F.col(text).alias("text")), key, "text")
    result = _components(marked.select(RID, "text"), k, percent, hot, counted, group).withColumnRenamed("component", "component_id")
    links = ["n_links"] if counted else []
    if back is not None:  # ids of components are those of documents
        names = marked.select(F.col(RID).alias("component_id"), F.col(key).alias("_key"))
        result = result.join(names, "component_id").select(RID, "n_shingles", F.col("_key").alias("component_id"), *links)
    return given_rows(result.select(RID, "n_shingles", "component_id", *links), back, key)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = GRAM, percent: int = PERCENT, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """docs without near copies: of each component the row with the smallest key stays, and of rows that repeat key and text one.

    Null and empty texts are near copies of nothing and stay; a null key counts as largest; an empty table stays one. All columns
    are kept, whatever their names.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct("*").alias("_row"))
    marked, _ = identified(rows, "_key", "_text")
    first = _components(marked.select(RID, F.col("_text").alias("text")), k, percent, hot, counted=False, group=group).where(F.col(RID) == F.col("component")).select(RID)
    return marked.join(first, RID).select("_row.*")
