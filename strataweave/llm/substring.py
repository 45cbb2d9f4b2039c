r"""Substring deduplication: repeated windows of words by FM-indexes of shards.

A window's shard is chosen by content: its key is the smallest hash of the 4-word
runs in it, so equal windows share a shard wherever they stand, and no document
has to be streamed through the other shards. Runs of windows with one key form a
segment (at most ``SEGMENT`` windows; the windows' words overlap into it). Keys
that one segment alone has, without a repeat within, leave after a shuffle of hashes only.
Segments with the words of an earlier one in their block of documents are settled
there and don't meet in the shard, so copies reach it once from each block; the
windows of keys that many segments share are dealt out by all their words.

In a shard, the first segment of each key goes into an FM-index: the Burrows-Wheeler
transform in a wavelet matrix, common prefixes as bytes, and sampled positions; no text and no suffix
array. The other segments are streamed through it by backward search, all of them at once, which gives their matching statistics: a match that can't be extended is
shortened to its parent interval. Windows whose match reaches 20 words repeat. What is
still open is indexed in turn (the next four of each key, then sixteen and so on) for those after
it; repeats within one index show in classes of several rows, by the earliest position of each.

Only segments that equal an earlier one of their own block of documents (``BLOCK`` bytes), and windows of hot keys, are settled by comparing
words; all others, copies among them, are found by the index. ``windows_found`` counts both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.llm.identity import RID, given_rows, identified
from strataweave.llm.textblocks import U, Words, gather_ranges, gram_hashes, inside, pieces, string_array, strings, trimmed
from strataweave.session import dealt, forget, materialize, shuffle_width

WINDOW = 20
GRAM = 4
#: windows in a segment at most; with the words that the last one reaches, 63 words
SEGMENT = 44
DEPTH = 64
#: rows of one key from which its windows go by their own hash
HOT_KEY = 2_000
#: bytes of text in which equal segments are settled before a shuffle
BLOCK = 2 << 20
#: words in one FM-index, but for a key with more
SHARD_WORDS = 1 << 20


# -- segments ------------------------------------------------------------------------

def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    n, span = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def segments(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, first window within the text, windows, whether a window may repeat within) of all segments."""
    at = inside(w.count, w.ptr, WINDOW)
    if not len(at):
        return np.zeros(0, U), at, at, at, np.zeros(0, bool)
    grams = gram_hashes(w.hashes(), GRAM)
    key = sliding_min(grams, WINDOW - GRAM + 1)[at]
    text = w.owner()[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    new[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % SEGMENT == 0] = True
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(at)))
    # a window that begins twice in a segment brings the run that is its key twice
    reach = n + WINDOW - GRAM
    place = np.repeat(at[start] - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
    twice = np.add.reduceat((grams[place] == np.repeat(key[start], reach)).astype(np.int8), np.cumsum(reach) - reach) > 1
    return key[start], text[start], at[start] - w.ptr[text[start]], n, twice & (n > 1)


def _cut_words(w: Words, text: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """The words of segments, white space as spaces."""
    a = w.ptr[text] + first
    start, end = w.start[a], w.end[a + n + WINDOW - 2]
    data, off = gather_ranges(w.buf, start, end - start)
    return string_array(np.where((data >= 9) & (data <= 13), np.uint8(32), data), off)


def _repeats(words: pa.Array, key: np.ndarray, rid: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Segments with key and words of an earlier one (smaller id, or further left)."""
    code = np.asarray(words.dictionary_encode().indices, np.int64)
    order = np.lexsort((first, rid, key, code))
    out = np.zeros(len(order), bool)
    out[order[1:]] = (code[order[1:]] == code[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
    return out


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, _rid, place, done, own): a segment that repeats one of the same block is done, as all its windows begin earlier; own marks those with repeats within."""
    for batch in pieces(batches, "text", BLOCK):
        w = Words(strings(batch.column("text")))
        key, text, first, n, own = segments(w)
        key = key.view(np.int64)
        rid = np.asarray(batch.column(RID), np.int64)
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key), bool)
        same[order[1:]] = key[order[1:]] == key[order[:-1]]
        same[order[:-1]] |= same[order[1:]]
        some = np.flatnonzero(same)
        done = np.zeros(len(key), bool)
        done[some] = _repeats(_cut_words(w, text[some], first[some], n[some]), key[some], rid[text[some]], first[some])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rid[text]), pa.array(first << 6 | n), pa.array(done), pa.array(own)], names=["key", RID, "place", "done", "own"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of wanted segments. Done ones, and of equal ones in a block all but the earliest, come without words: they repeat."""
    for batch in pieces(batches, "text", BLOCK):
        w = Words(strings(batch.column("text")))
        wanted = batch.column("wanted")
        flat = wanted.flatten()
        text = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(wanted.offsets)))
        key, place, hot, done = (np.asarray(flat.field(i)) for i in range(4))
        first, n = place >> 6, place & 63
        if hot.any():  # windows of their own, keyed by all their words
            many = np.where(hot, n, 1)
            at = np.repeat(np.arange(len(key)), many)
            step = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            key, text, first, n, hot, done = key[at], text[at], first[at] + np.where(hot[at], step, 0), np.where(hot[at], 1, n[at]), hot[at], done[at]
            key = np.where(hot, gram_hashes(w.hashes(), WINDOW)[np.minimum(w.ptr[text] + first, max(0, len(w.start) - WINDOW))].view(np.int64), key)
        rid = np.asarray(batch.column(RID), np.int64)[text]
        open_ = np.flatnonzero(~done)
        words = _cut_words(w, text[open_], first[open_], n[open_])
        fresh = ~_repeats(words, key[open_], rid[open_], first[open_])
        shown = np.zeros(len(key), bool)
        shown[open_] = fresh
        back = np.cumsum(shown) - 1
        column = words.filter(pa.array(fresh)).take(pa.array(back, mask=~shown)) if shown.any() else pa.nulls(len(key), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(rid, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int32()), pa.array(hot), column], names=["key", RID, "first", "n", "hot", "words"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of hot keys that repeat one of the same partition lose their words; the others go on."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    del got
    key, rid, first = (t[c].to_numpy().astype(np.int64) for c in ("key", RID, "first"))
    words = strings(t["words"])
    again = _repeats(words, key, rid, first)
    t = t.set_column(t.schema.get_field_index("words"), "words", pc.if_else(pa.array(again), None, words))
    yield from t.combine_chunks().to_batches(max_chunksize=50_000)


# -- FM-index ------------------------------------------------------------------------

#: the bits below each of 64
_BELOW = (U(1) << np.arange(64, dtype=U)) - U(1)


class BitVector:
    """Bits with ranks by 64-bit popcount blocks."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        p = np.packbits(bits, bitorder="little")
        packed[: len(p)] = p
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & _BELOW[at & 63])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(U) & U(1)).astype(bool)


class WaveletMatrix:
    """Rank over a sequence of symbols below 2**bits: one bit vector for each bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits = len(symbols), bits
        self.levels, self.zeros = [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        #: where each symbol's own run begins on the lowest level
        order = np.arange(1 << bits)
        place = np.zeros(1 << bits, np.int64)
        for level in range(bits):
            place = self._step(level, place, (order >> (bits - 1 - level) & 1).astype(bool))
        self.first = place

    def _step(self, level: int, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        ones = self.levels[level].rank(at)
        return np.where(one, self.zeros[level] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        for level in range(self.bits):
            at = self._step(level, at, (symbol >> (self.bits - 1 - level) & 1).astype(bool))
        return at - self.first[symbol]


class Minima:
    """Nearest smaller values of a byte array by a tree of minima of ``WIDTH`` values each."""

    WIDTH = 64

    def __init__(self, values: np.ndarray):
        self.levels = []
        while True:
            full = np.full(-(-len(values) // self.WIDTH) * self.WIDTH, 255, np.uint8)
            full[: len(values)] = values
            self.levels.append(full.reshape(-1, self.WIDTH))
            if len(self.levels[-1]) == 1:
                break
            values = self.levels[-1].min(1)

    def _seek(self, at: np.ndarray, bound: np.ndarray, right: bool) -> np.ndarray:
        """The nearest place from ``at`` on, to the right or left, with a value below ``bound``; there must be one."""
        out = at.copy()
        todo, place, level = np.arange(len(at)), at, 0
        lane = np.arange(self.WIDTH)
        while len(todo):
            block, within = place // self.WIDTH, place % self.WIDTH
            rows = self.levels[level][block] < bound[todo, None]
            rows &= lane >= within[:, None] if right else lane <= within[:, None]
            hit = rows.any(1)
            found = rows.argmax(1) if right else self.WIDTH - 1 - rows[:, ::-1].argmax(1)
            here = block * self.WIDTH + found
            done, where = todo[hit], here[hit]
            for below in range(level - 1, -1, -1):  # down to the value itself
                rows = self.levels[below][where] < bound[done, None]
                where = where * self.WIDTH + (rows.argmax(1) if right else self.WIDTH - 1 - rows[:, ::-1].argmax(1))
            out[done] = where
            todo, place, level = todo[~hit], block[~hit] + (1 if right else -1), level + 1
        return out

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return self._seek(at, bound, False)

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return self._seek(at, bound, True)


class FMIndex:
    """Compressed index over texts of word ids (from 1), each at most ``DEPTH`` - 1 long.

    It keeps the Burrows-Wheeler transform in a wavelet matrix, the common prefixes of neighbouring
    rows as bytes, a bit for each row that begins a class of suffixes with equal first ``threshold`` words,
    and of positions one sample for each class of several rows: its earliest. The texts and the
    suffix array are dropped when it is built. Rows are sorted to ``DEPTH`` words, as far as any match goes.
    """

    def __init__(self, ids: np.ndarray, length: np.ndarray, threshold: int = WINDOW):
        self.threshold = threshold
        #: each text is followed by the sign 0
        text = np.zeros(int((length + 1).sum()), np.int64)
        text[np.arange(len(ids)) + np.repeat(np.arange(len(length)), length)] = ids
        self.n = n = len(text)
        rank, depth, saved = text, 1, {}
        rows = np.arange(n)
        while depth < DEPTH:
            saved[depth] = rank.astype(np.int32)
            joint = rank * (int(rank.max(initial=0)) + 1)
            joint[:-depth] += rank[depth:]
            rows = np.argsort(joint, kind="stable")
            s = joint[rows]
            rank = np.empty(n, np.int64)
            rank[rows] = np.cumsum(np.append(False, s[1:] != s[:-1])[:n])
            depth *= 2
        # words that each row has in common with the one before
        common = np.zeros(n + 1, np.uint8)
        a, b = rows[:-1].copy(), rows[1:].copy()
        for d in sorted(saved, reverse=True):
            equal = np.flatnonzero((a < n) & (b < n))
            equal = equal[saved[d][a[equal]] == saved[d][b[equal]]]
            a[equal] += d
            b[equal] += d
            common[1 + equal] += d
        del saved, joint, rank
        self.common = Minima(common)
        head = common[:n] < threshold
        self.head = BitVector(head)
        start = np.flatnonzero(head)
        several = np.diff(np.append(start, n)) > 1
        self.several = BitVector(several)
        #: the earliest position in each class of several rows
        self.sample = np.minimum.reduceat(rows, start)[several] if n else rows
        top = int(text.max(initial=0))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bwt = WaveletMatrix(text[rows - 1], max(1, top.bit_length()))

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows of the matches with a word before them; none for words that the index doesn't have."""
        known = symbol < len(self.less) - 1
        at = np.where(known, symbol, 0)
        both = self.bwt.rank(np.concatenate([at, at]), np.concatenate([low, high]))
        low, high = self.less[at] + both[: len(at)], self.less[at] + both[len(at) :]
        return low, np.where(known, high, low)

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, length) of the longest shorter prefix of each match that has more rows."""
        at = self.common.levels[0].ravel()
        length = np.maximum(at[low], at[high])
        out = np.zeros(len(low), np.int64), np.full(len(low), self.n)
        some = np.flatnonzero(length)
        out[0][some], out[1][some] = self.common.left(low[some], length[some]), self.common.right(high[some], length[some])
        return *out, length.astype(np.int64)

    def statistics(self, ids: np.ndarray, length: np.ndarray, least: int | None = None) -> tuple[np.ndarray, ...]:
        """Matching statistics of streamed texts: (text, start, words, low, high) wherever the longest match from ``start`` on has ``least`` words or more.

        All texts are searched at once. A match that the index has with the word before it grows by that; else it is
        shortened to its parent interval, until it grows or is empty. Texts that can't reach ``least`` words any more leave.
        """
        least = self.threshold if least is None else least
        at = np.cumsum(length) - length
        seg = np.arange(len(length))
        left = length.copy()  # words before the match
        low, high, size = np.zeros(len(seg), np.int64), np.full(len(seg), self.n), np.zeros(len(seg), np.int64)
        out = []
        while True:
            live = np.flatnonzero((left > 0) & (left + size >= least))
            if len(live) < len(seg):
                seg, left, low, high, size = seg[live], left[live], low[live], high[live], size[live]
            if not len(seg):
                break
            a, b = self.back(ids[at[seg] + left - 1], low, high)
            ok = a < b
            low, high = np.where(ok, a, low), np.where(ok, b, high)
            miss = np.flatnonzero(~ok)
            if not len(miss):
                size += 1
                left -= 1
                hit = np.flatnonzero(size >= least)
            else:
                size += ok
                left -= ok | (size == 0)  # an empty match passes over the word
                some = miss[size[miss] > 0]
                low[some], high[some], size[some] = self.parent(low[some], high[some])
                hit = np.flatnonzero(ok & (size >= least))
            if len(hit):
                out.append((seg[hit], left[hit], size[hit], low[hit], high[hit]))
        return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(5))

    def earlier(self, low: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether matches of ``threshold`` words or more begin before a position; a class of one row is that row itself."""
        of = self.head.rank(low + 1) - 1
        some = np.flatnonzero(self.several.get(of))
        out = np.zeros(len(low), bool)
        out[some] = self.sample[self.several.rank(of[some])] < position[some]
        return out


def repeated_windows(ids: np.ndarray, length: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of all windows whose words also begin earlier: in an earlier segment of their key, or further left.

    Segments stand in the order of key, then of time. An index holds the first segment of each
    key, the next one the next four, then sixteen and so on. Its own segments and all later ones are streamed through it;
    segments of which every window is found are closed, and no later index holds them.
    """
    n = np.maximum(length - WINDOW + 1, 0)
    base = np.cumsum(n) - n
    found = np.zeros(int(n.sum()), bool)
    at = np.cumsum(length) - length
    head = np.append(True, key[1:] != key[:-1])[: len(key)]
    rank = np.arange(len(key)) - np.flatnonzero(head)[np.cumsum(head) - 1]
    turn = np.searchsorted(np.cumsum(4 ** np.arange(20)), rank, "right")
    open_ = n > 0
    for now in range(int(turn.max(initial=-1)) + 1):
        own = np.flatnonzero(open_ & (turn == now))
        later = np.flatnonzero(open_ & (turn > now))
        if not len(own):
            continue
        taken = lambda which: ids[np.repeat(at[which] - (np.cumsum(length[which]) - length[which]), length[which]) + np.arange(length[which].sum())]
        fm = FMIndex(taken(own), length[own])
        place = np.cumsum(length[own] + 1) - (length[own] + 1)
        if len(fm.sample):
            seg, start, _, low, _ = fm.statistics(taken(own), length[own])
            again = fm.earlier(low, place[seg] + start)
            found[base[own[seg[again]]] + start[again]] = True
        if len(later):
            seg, start, _, _, _ = fm.statistics(taken(later), length[later])
            found[base[later[seg]] + start] = True
            whole = np.add.reduceat(np.append(found, False).astype(np.int64), base) == n
            open_ = (n > 0) & ~whole
    hit = np.flatnonzero(found)
    seg = np.searchsorted(base, hit, "right") - 1
    return seg, hit - base[seg]


def _shard(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = []
        for b in batches:
            words = b.column("words")
            known = np.asarray(words.is_valid())
            rid, first, n = (np.asarray(b.column(c), np.int64) for c in (RID, "first", "n"))
            if not known.all():
                yield _ranges(rid[~known], first[~known], n[~known])
            if known.any():
                tables.append(b.filter(pa.array(known)))
        if not tables:
            return
        t = pa.Table.from_batches(tables).sort_by([("key", "ascending"), (RID, "ascending"), ("first", "ascending")]).combine_chunks()
        key, rid, first, n = (t[c].to_numpy().astype(np.int64) for c in ("key", RID, "first", "n"))
        texts = strings(t["words"])
        total = np.cumsum(n + WINDOW - 1)
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        i = 0
        while i < len(key):
            # whole keys, up to shard_words words
            limit = np.searchsorted(total, (total[i - 1] if i else 0) + shard_words, "right")
            j = int(heads[np.searchsorted(heads, limit, "right") - 1])
            if j <= i:
                later = heads[heads > i]
                j = int(later[0]) if len(later) else len(key)
            if limit >= len(key):
                j = len(key)
            yield _search(key[i:j], rid[i:j], first[i:j], n[i:j], texts.slice(i, j - i))
            i = j

    return run


def _ranges(rid: np.ndarray, first: np.ndarray, n: np.ndarray, searched: np.ndarray | None = None) -> pa.RecordBatch:
    """Words covered by n windows from ``first`` on, and whether the index found them."""
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(first), pa.array(first + n + WINDOW - 1), pa.array(np.zeros(len(rid), bool) if searched is None else searched)], names=[RID, "a", "b", "searched"])


def _search(key: np.ndarray, rid: np.ndarray, first: np.ndarray, n: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    # rows are sorted by key, rid, first: the order in which their windows begin
    w = Words(texts)
    seg, start = repeated_windows(w.codes()[0] + 1, w.count, key)
    head = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (start[1:] != start[:-1] + 1))[: len(seg)])
    run = np.diff(np.append(head, len(seg)))
    own = seg[head]
    return _ranges(rid[own], first[own] + start[head], run, np.ones(len(own), bool))


# -- operator ------------------------------------------------------------------------

_CUT = f"key long, {RID} long, first long, n int, hot boolean, words string"


def repeated_ranges(docs: DataFrame, hot_key: int = HOT_KEY, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """(_rid, a, b, searched): word ranges [a, b) covered by repeated windows, found by the index or not; ranges may overlap. docs: _rid, text. And the shuffle partitions that the texts' bytes call for.

    Keys are counted with a map-side combine, written, and joined back, which AQE splits where a key is hot. Windows of hot keys are
    settled in two steps, by window and salt and then by window, so a passage of a third of all documents meets in no single task.
    """
    docs = docs.select(RID, "text")
    width = shuffle_width(docs)
    rows = materialize(docs.mapInArrow(trimmed(_segment_rows), f"key long, {RID} long, place long, done boolean, own boolean"), "segments")
    open_ = rows.where("not done")
    counts = materialize(open_.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("own").alias("own")).where("n > 1 or own").drop("own"), "counts", width)
    shared = open_.join(counts, "key").select("key", RID, "place", (F.col("n") >= hot_key).alias("hot"), "done")
    wanted = shared.unionByName(rows.where("done").select("key", RID, "place", F.lit(False).alias("hot"), "done"))
    lists = materialize(wanted.groupBy(RID).agg(F.collect_list(F.struct("key", "place", "hot", "done")).alias("wanted")), "wanted", width)
    forget(rows)
    forget(counts)
    cut = materialize(docs.join(lists.hint("shuffle_hash"), RID).select(RID, "text", "wanted").mapInArrow(trimmed(_cut), _CUT), "cut", width)
    forget(lists)
    salt = F.pmod(F.xxhash64(RID), F.lit(max(16, width)))
    hot = materialize(dealt(cut.where("hot and words is not null"), width, F.xxhash64("key", salt)).mapInArrow(trimmed(_settle), _CUT), "hot", width)
    rest = cut.where("not hot or words is null").unionByName(hot)
    spread = F.when(F.col("words").isNull(), F.xxhash64(RID, "first")).otherwise(F.col("key"))
    ranges = materialize(dealt(rest, width, spread).mapInArrow(trimmed(_shard(shard_words)), f"{RID} long, a long, b long, searched boolean"), "ranges", width)
    forget(cut)
    forget(hot)
    return ranges, width


def windows_found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(searched, windows): repeated windows that the index found, and those of segments equal to an earlier one."""
    marked, _ = identified(docs.select(key, F.col(text).alias("text")), key, "text")
    ranges, _ = repeated_ranges(marked)
    return ranges.groupBy("searched").agg(F.sum(F.col("b") - F.col("a") - (WINDOW - 1)).alias("windows"))


def _apply(rewrite: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = strings(batch.column("text"))
            w = Words(texts)
            edge = np.zeros(len(w.start) + 1, np.int64)
            ranges = batch.column("ranges")
            at = np.asarray(ranges.is_valid())
            if at.any():
                flat = ranges.flatten()
                sizes = np.where(at, np.asarray(ranges.value_lengths().fill_null(0)), 0)
                base = np.repeat(w.ptr[:-1], sizes)
                np.add.at(edge, base + np.asarray(flat.field(0)), 1)
                np.add.at(edge, base + np.asarray(flat.field(1)), -1)
            gone = np.cumsum(edge)[:-1] > 0
            lost = np.concatenate([[0], np.cumsum(gone)])
            removed = lost[w.ptr[1:]] - lost[w.ptr[:-1]]
            # kept words and the spaces between them
            stay = np.flatnonzero(~gone)
            owner = w.owner()[stay]
            last = np.append(owner[1:] != owner[:-1], True)[: len(stay)]
            data, off = gather_ranges(w.buf, w.start[stay], w.end[stay] - w.start[stay] + 1 - last)
            spaces = off[1:][~last] - 1
            data = data.copy()
            data[spaces] = 32
            bounds = off[np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=w.n))])]
            columns = [batch.column(c) for c in keep] + [pa.array(w.count), pa.array(removed)]
            if rewrite:
                columns.append(pc.if_else(pa.array(removed == 0), texts, string_array(data, bounds)))
            else:
                view = data.tobytes()
                columns.append(pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "n_removed", "kept_text" if rewrite else "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, rewrite: bool = False, hot_key: int = HOT_KEY, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Remove every word covered by a window of 20 words that also begins earlier (smaller key, or further left in the same text).

    Returns key, the columns ``keep``, n_words, n_removed, and kept_sha256 of the kept words
    joined by one space or, with ``rewrite``, kept_text: the same words, but the text as
    it was where nothing is removed. Null and empty texts have no
    words. Keys need not be unique: see ``identified``; rows that repeat key and text
    are one document and get the same result, and ``keep`` then comes from one of
    them. An empty table gives no rows. Columns of docs named like an output are dropped.
    """
    own = {"n_words", "n_removed", "kept_text", "kept_sha256", RID, "text", "ranges", "wanted", key}
    keep = [c for c in keep or [] if c not in own]
    marked, back = identified(docs.select(*[key, *keep], F.col(text).alias("text")), key, "text")
    marked = marked.select(RID, *keep, "text")
    ranges, width = repeated_ranges(marked, hot_key, shard_words)
    lists = dealt(ranges, width, RID).groupBy(RID).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    schema = T.StructType([marked.schema[c] for c in [RID, *keep]] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text" if rewrite else "kept_sha256", T.StringType())])
    done = dealt(marked, width, RID).join(lists.hint("shuffle_hash"), RID, "left").select(RID, *keep, "text", "ranges").mapInArrow(trimmed(_apply(rewrite, [RID, *keep])), schema)
    return given_rows(done, back, key)


