r"""Words of many texts at once: numpy over the raw UTF-8 of an Arrow column.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 is the
same as ``[^\x20\x09-\x0D]+`` over code points.

What is counted or linked goes by *codes*, which number the distinct words of a block by their
bytes, or by *keyed hashes* (under a key drawn for the run), where words of
different blocks must meet. Plain hashes (ranges of up to ``LONG`` bytes eight bytes at a time through a mixing bijection, all ranges
at once; longer ones through XXH3) are equal for equal words on every machine, but anyone can make words that share one: they
choose places and order only, never a result.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_NONSPACE = np.ones(256, bool)
_NONSPACE[[9, 10, 11, 12, 13, 32]] = False
#: bytes of a range from which it is hashed by itself
LONG = 256
#: the low 0 to 8 bytes of eight
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def trimmed(run):
    """A function over batches that gives memory back when its partition ends: Spark keeps idle workers, and these keep what the allocators hold."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return ended


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every output bit depends on every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column without nulls (null: empty), in one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column without nulls; the offsets count from 0."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of whole rows with at most ``max_bytes`` of text each (one row may be larger)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = raw(strings(batch.column(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


@functools.lru_cache(4)
def _key_numbers(key: bytes) -> np.ndarray:
    """Two rows of 64-bit numbers from a key: one for each character of a word of ``LONG`` bytes, and two more."""
    n = LONG // 4 + 4
    return np.frombuffer(hashlib.shake_256(key).digest(16 * n), "<u8").reshape(2, n)


class Words:
    """The words of a column of texts: byte positions, owners and hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        buf, off = raw(column)
        if lower:
            buf = buf + np.where((buf >= 65) & (buf <= 90), np.uint8(32), np.uint8(0))
        self.buf, self.off, self.n = buf, off, len(off) - 1
        word = _NONSPACE[buf]
        before = np.zeros(len(buf), bool)
        before[1:] = word[:-1]
        heads = off[:-1]
        before[heads[heads < len(buf)]] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.zeros(len(buf), bool)
        after[:-1] = word[1:]
        ends = off[1:]
        after[ends[ends > 0] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        #: words before each text; text i has words ptr[i] to ptr[i + 1]
        self.ptr = np.searchsorted(self.start, off)
        self.count = np.diff(self.ptr)
        self._eights: np.ndarray | None = None

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.count)

    def _lanes(self) -> np.ndarray:
        """The eight bytes from each place on."""
        if self._eights is None:
            padded = np.zeros(len(self.buf) + 8, np.uint8)
            padded[: len(self.buf)] = self.buf
            self._eights = np.ndarray(len(self.buf) + 1, "<u8", padded, strides=(1,))
        return self._eights

    def range_codes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(codes, values): byte ranges numbered by what they hold, so that equal codes are equal bytes, and the bytes of each code."""
        held = string_array(*gather_ranges(self.buf, start, end - start), binary=True, cast=False).dictionary_encode()
        return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """(codes, values) of the words."""
        return self.range_codes(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Plain hashes of byte ranges."""
        length = end - start
        h = mix(length.astype(U) * _MULT)
        live, step = np.flatnonzero((length > 0) & (length <= LONG)), 0
        while len(live):
            left = length[live] - step
            h[live] = mix(h[live] ^ (self._lanes()[start[live] + step] & _LOW[np.minimum(left, 8)]))
            live, step = live[left > 8], step + 8
        view = memoryview(np.ascontiguousarray(self.buf))
        for i in np.flatnonzero(length > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(view[start[i] : end[i]])
        return h

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def keyed_hashes(self, key: bytes) -> np.ndarray:
        """64 bits of each word under a key drawn for the run: any two words, whoever chose them before, share them by a chance of 2**-64.

        Two multilinear hashes over four-byte characters, length first, of which each gives its upper half (Lemire and Kaser, 2014);
        words longer than ``LONG`` go through keyed BLAKE2b.
        """
        m, half = _key_numbers(key), U(0xFFFFFFFF)
        length = self.end - self.start
        sums = [m[i, 0] + m[i, 1] * length.astype(U) for i in range(2)]
        live, step = np.flatnonzero(length <= LONG), 0
        while len(live):
            left = length[live] - step
            eight = self._lanes()[self.start[live] + step] & _LOW[np.minimum(left, 8)]
            low, high = eight & half, eight >> U(32)
            for i in range(2):
                sums[i][live] += m[i, 2 + step // 4] * low + m[i, 3 + step // 4] * high
            live, step = live[left > 8], step + 8
        h = (sums[0] & ~half) | (sums[1] >> U(32))
        view = memoryview(np.ascontiguousarray(self.buf))
        for i in np.flatnonzero(length > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(view[self.start[i] : self.end[i]], digest_size=8, key=key).digest(), "little")
        return mix(h)

    def gram_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, offsets): the distinct runs of k words of each text, ascending; with fewer words the whole sequence is one. Equal codes are equal runs, in all texts."""
        # k - 1 places without a word after each text
        padded = np.zeros(len(self.start) + self.n * (k - 1), np.int64)
        padded[np.arange(len(self.start)) + self.owner() * (k - 1)] = self.codes()[0] + 1
        n = np.maximum(self.count - k + 1, self.count > 0)
        owner = np.repeat(np.arange(self.n), n)
        at = np.repeat(self.ptr[:-1] + np.arange(self.n) * (k - 1) - (np.cumsum(n) - n), n) + np.arange(n.sum())
        grams = gram_codes(padded, k)[at] if len(at) else np.zeros(0, np.int64)
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))[: len(grams)]
        return grams[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=self.n))])


def gram_hashes(words: np.ndarray, k: int, factor: np.uint64 = _MULT) -> np.ndarray:
    """Hashes of all runs of k words, text borders ignored: one for each of the first len - k + 1 words. ``factor``: an odd number, secret for keyed hashes."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, U)
    for j in range(k):
        h = h * factor + words[j : j + n]
    return mix(h)


def secret_factor(key: bytes) -> np.uint64:
    """An odd number from a key."""
    return U(int.from_bytes(hashlib.blake2b(b"factor", digest_size=8, key=key).digest(), "little") | 1)


def code_pairs(a: np.ndarray, b: np.ndarray, n_b: int) -> np.ndarray:
    """One number for each pair of numbers, b below ``n_b``: different pairs have different ones. The larger a is numbered anew where it would not fit."""
    if len(a) and int(a.max()) >= (1 << 62) // max(n_b, 1):
        a = pa.array(a).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return a * n_b + b


def gram_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Numbers of all runs of k codes, text borders ignored: equal numbers are equal runs."""
    n = max(0, len(codes) - k + 1)
    if not n:
        return np.zeros(0, np.int64)
    size = int(codes.max()) + 1
    out = codes[:n]
    for j in range(1, k):
        out = code_pairs(out, codes[j : j + n], size)
    return out


def inside(count: np.ndarray, ptr: np.ndarray, k: int) -> np.ndarray:
    """The words that begin a run of k words within their own text."""
    full = np.maximum(count - k + 1, 0)
    return np.repeat(ptr[:-1] - np.concatenate([[0], np.cumsum(full)[:-1]]), full) + np.arange(full.sum())


def gather_ranges(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many ranges in a row, and their offsets."""
    off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=off[1:])
    if not len(start):
        return buf[:0], off
    at = np.ones(off[-1], np.int64)
    full = np.flatnonzero(length)
    if not len(full):
        return buf[:0], off
    s, n = start[full], length[full]
    at[0] = s[0]
    at[off[full[1:]]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return buf[np.cumsum(at)], off


def string_array(data: np.ndarray, off: np.ndarray, binary: bool = False, cast: bool = True) -> pa.Array:
    """An Arrow column from bytes and offsets; without ``cast`` one of 64-bit offsets."""
    kind = pa.large_binary() if binary else pa.large_string()
    big = pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return big.cast(pa.binary() if binary else pa.string()) if cast else big
