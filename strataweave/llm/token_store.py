"""Token-id files: one concatenated id array with Elias-Fano document boundaries.

File, little-endian: magic ``EFTOK2\\0\\0``; eight uint64 (documents, documents with a null key, which are
the last, ids, bytes per id; low bits and bytes of the high part of the boundaries, and of the keys) and the
first key (int64); the boundaries, then the keys less the first one, each as packed low bits,
high bits (bit i + (value >> low) is set for value i) and the ones before each 512-bit block of
the high part (uint32); the ids. Value i is found by select in the high part and a read of the low part: about
2 + log2(range / documents) bits each, and no table of 64-bit offsets or keys. Keys that span
2**62 or more are written as int64 (their low bits say 64).
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.llm.textblocks import Words, gather_ranges, pieces, raw, string_array, strings, trimmed
from strataweave.session import materialize, shared_dir, shuffle_width

MAGIC = b"EFTOK2\0\0"
BLOCK = 512
#: words kept with their ids in a worker process, in each of two generations
CACHED_WORDS = 200_000
#: ids read at a time, about
READ_IDS = 1 << 20


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = np.zeros(-(-(n + (top >> low_bits) + 1) // BLOCK) * BLOCK, np.uint8)
        high[(values >> low_bits) + np.arange(n)] = 1
        # eight values fill whole bytes
        low = np.concatenate([np.packbits(((values[i : i + 65_536, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel(), bitorder="little") for i in range(0, max(n, 1), 65_536)])
        ones = np.concatenate([[0], np.cumsum(high.reshape(-1, BLOCK).sum(1, dtype=np.int64))[:-1]]).astype("<u4")
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ones)

    def tobytes(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.ones.tobytes()

    @classmethod
    def read(cls, file, n: int, low_bits: int, high: int) -> EliasFano:
        low = np.frombuffer(file.read(-(-n * low_bits // 8)), np.uint8)
        words = np.frombuffer(file.read(high), np.uint8)
        return cls(n, low_bits, low, words, np.frombuffer(file.read(4 * (high * 8 // BLOCK)), "<u4"))

    def select(self, at: np.ndarray) -> np.ndarray:
        """The values at positions ``at``: find the block of the one, then the one within it."""
        at = np.asarray(at, np.int64)
        if not len(at):
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.ones, at, "right") - 1
        words = self.high.view("<u8").reshape(-1, BLOCK // 64)
        left = at - self.ones[block]
        inside = np.cumsum(np.bitwise_count(words[block]).astype(np.int64), 1)
        word = (inside <= left[:, None]).sum(1)
        left -= np.where(word > 0, np.take_along_axis(inside, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        bits = np.unpackbits(words[block, word][:, None].view(np.uint8), axis=1, bitorder="little")
        place = np.argmax(np.cumsum(bits, 1) == left[:, None] + 1, 1)
        upper = block * BLOCK + word * 64 + place - at
        bit = at[:, None] * self.low_bits + np.arange(self.low_bits)
        lower = ((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)
        return (upper << self.low_bits) + lower.sum(1)


def write_store(stream, keys: np.ndarray, nulls: int, boundaries: np.ndarray, ids: list[np.ndarray], width: int) -> int:
    """Write a file; returns its bytes. keys: those that are not null, ascending; ``nulls`` documents follow them."""
    base = int(keys[0]) if len(keys) else 0
    wide = len(keys) > 0 and int(keys[-1]) - base >= 1 << 62
    ef, coded = EliasFano.encode(boundaries), EliasFano.encode(np.zeros(0, np.int64) if wide else keys - base)
    head = MAGIC + struct.pack("<8Qq", len(keys) + nulls, nulls, int(boundaries[-1]), width, ef.low_bits, len(ef.high), 64 if wide else coded.low_bits, len(coded.high), base)
    head += ef.tobytes() + (keys.astype("<i8").tobytes() if wide else coded.tobytes())
    stream.write(head)
    for part in ids:
        stream.write(part.astype(f"<u{width}").tobytes())
    return len(head) + int(boundaries[-1]) * width


class TokenFile:
    """Reader of a file; ids are read by range, boundaries and keys by select."""

    def __init__(self, file):
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a token file")
        self.n, nulls, self.total, self.width, low_bits, high, key_bits, key_high, self.base = struct.unpack("<8Qq", file.read(72))
        self.known = self.n - nulls
        self.boundaries = EliasFano.read(file, self.n + 1, low_bits, high)
        self.raw = np.frombuffer(file.read(8 * self.known), "<i8") if key_bits == 64 else None
        self.coded = EliasFano.read(file, self.known, key_bits, key_high) if key_bits < 64 else None
        self.at = file.tell()

    def keys(self, first: int, last: int) -> pa.Array:
        """Keys of documents [first, last)."""
        end = min(last, self.known)
        known = self.raw[first:end] if self.raw is not None else self.base + self.coded.select(np.arange(first, max(first, end)))
        return pa.concat_arrays([pa.array(known, pa.int64()), pa.nulls(last - max(first, end), pa.int64())])

    def ids(self, first: int, last: int) -> np.ndarray:
        self.file.seek(self.at + first * self.width)
        return np.frombuffer(self.file.read((last - first) * self.width), f"<u{self.width}")

    def blocks(self, documents: int = 4096, ids: int = READ_IDS) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, boundaries) of blocks of documents with at most about so many ids; one document may have more."""
        for i in range(0, self.n, documents):
            b = self.boundaries.select(np.arange(i, min(self.n, i + documents) + 1))
            at = 0
            while at < len(b) - 1:
                to = max(at + 1, int(np.searchsorted(b, b[at] + ids, "right")) - 1)
                yield i + at, b[at : to + 1]
                at = to


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, [{}, {}]


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[bytes, ...]:
    """The contents of the added tokens, A-Z lower-cased."""
    tokens = _tokenizer(path)[0].get_added_tokens_decoder().values()
    return tuple(t.content.encode().lower() for t in tokens if t.content)


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = True


def units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first unit of each text): words, parted between ASCII letters and ASCII signs other than the apostrophe."""
    letter, sign = _LETTER[w.buf], _SIGN[w.buf]
    border = np.flatnonzero(letter[:-1] & sign[1:] | sign[:-1] & letter[1:]) + 1
    border = border[~np.isin(border, w.off)]
    start, end = np.concatenate([w.start, border]), np.concatenate([w.end, border])
    start.sort()
    end.sort()
    return start, end, np.searchsorted(start, w.off)


def whole_texts(column: pa.Array, added: tuple[bytes, ...]) -> np.ndarray:
    """Positions of the texts that units can't make up: with the content of an added token (in any case), or a combining mark after a capital, which NFC may compose with the small letter only."""
    buf, off = raw(column)
    lower = (buf + np.where((buf >= 65) & (buf <= 90), np.uint8(32), np.uint8(0))).tobytes()
    found = []
    for content in added:
        at = lower.find(content)
        while at >= 0:
            found.append(at)
            at = lower.find(content, at + 1)
    # marks begin at U+0300, whose first byte is 0xCC
    after = np.flatnonzero((buf[:-1] - np.uint8(65) < 26) & (buf[1:] >= 0xCC))
    rows = np.unique(np.searchsorted(off, after, "right") - 1)
    marked = np.asarray(pc.match_substring_regex(column.take(pa.array(rows)), r"[A-Z]\p{M}"), bool)
    return np.union1d(rows[marked], np.searchsorted(off, np.array(found, np.int64), "right") - 1).astype(np.int64)


def encode_words(column: pa.Array, tokenizer_path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per text) of a column without nulls, ``end_id`` after each text: what the tokenizer gives for each whole text.

    Texts are encoded by units, but for those of ``whole_texts``.
    """
    whole = whole_texts(column, _added(tokenizer_path))
    if not len(whole):
        return _encode_units(column, tokenizer_path, end_id)
    mask = np.zeros(len(column), bool)
    mask[whole] = True
    ids, n = _encode_units(pc.if_else(pa.array(mask), "", column), tokenizer_path, end_id)
    got = _tokenizer(tokenizer_path)[0].encode_batch_fast(column.take(pa.array(whole)).to_pylist(), add_special_tokens=False)
    size = np.array([len(e.ids) for e in got], np.int64)
    ids = np.insert(ids, np.repeat(np.cumsum(n)[whole] - 1, size), np.concatenate([np.array(e.ids, ids.dtype) for e in got]))
    n[whole] += size
    return ids, n


def _encode_units(column: pa.Array, tokenizer_path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode_words``, by units alone.

    For tokenizers that lower-case, drop white space and part letters from signs before
    the merges: then no token spans two units, and each distinct unit of the block
    is encoded once. Units that this process has seen lately are looked up.
    """
    tokenizer, ages = _tokenizer(tokenizer_path)
    w = Words(column, lower=True)
    start, end, ptr = units(w)
    data, off = gather_ranges(w.buf, start, end - start)
    coded = string_array(data, off).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    found = list(map(ages[0].get, distinct))
    if len(ages[0]) > CACHED_WORDS:
        ages[:] = {}, ages[0]
    young, old = ages
    lost = [i for i, x in enumerate(found) if x is None]
    missing = []
    for i in lost:
        if (x := old.get(distinct[i])) is None:
            missing.append(i)
        else:
            found[i] = young[distinct[i]] = x
    for i, e in zip(missing, tokenizer.encode_batch_fast([distinct[i] for i in missing], add_special_tokens=False), strict=True):
        found[i] = young[distinct[i]] = array("I", e.ids).tobytes()
    found.append(array("I", [end_id]).tobytes())
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), np.uint32)
    first = np.cumsum(size) - size
    order = np.insert(np.asarray(coded.indices, np.int64), ptr[1:], len(distinct))
    ids, ends = gather_ranges(flat, first[order], size[order])
    return ids, np.diff(ends[np.concatenate([[0], ptr[1:] + np.arange(1, w.n + 1)])])


def _blocks(batches: Iterator[pa.RecordBatch], text: str, least: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to at least so many bytes of text: the more in one, the fewer times a word is looked up."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(text).nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, key: str = "doc_id", text: str = "text", tasks: int | None = None) -> DataFrame:
    """Write token files in ascending key order; returns the manifest (part, path, documents, ids, base).

    Documents are range-partitioned and sorted by key (nulls last; equal keys by
    the text's hash), encoded, and each partition writes one file. base is the number of ids in all
    files before. Null and empty texts have the end id alone; repeated rows are
    separate documents; an empty table gives no file.
    """
    from strataweave.llm.storage import attempt_name, open_output

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nulls, sizes, ids = [], 0, [], []
        width = 2 if _tokenizer(tokenizer_path)[0].get_vocab_size() <= 65_536 and end_id < 65_536 else 4
        for batch in _blocks(pieces(batches, text, 8 << 20), text, 6 << 20):
            got, n = encode_words(strings(batch.column(text)), tokenizer_path, end_id)
            k = batch.column(key)
            keys.append(np.asarray(pc.drop_null(k), np.int64))
            nulls += k.null_count
            sizes.append(n)
            ids.append(got.astype(f"<u{width}"))
        if not sizes:
            return
        part = TaskContext.get().partitionId()
        path = attempt_name(folder, part, ".eftok")
        boundaries = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        with open_output(path) as f:
            write_store(f, np.concatenate(keys), nulls, boundaries, ids, width)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "documents": [len(boundaries) - 1], "ids": [int(boundaries[-1])]})

    by = [F.col(key).asc_nulls_last(), F.col("_tie")]
    rows = docs.select(F.col(key).cast("long").alias(key), text, F.xxhash64(text).alias("_tie"))
    # a task holds its ids, two bytes each, until the boundaries are known
    width = tasks or shuffle_width(docs, text)
    wider = tasks is not None or width > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(width, *by) if wider else rows.repartitionByRange(*by)
    manifest = materialize(ranged.sortWithinPartitions(*by).select(key, text).mapInArrow(trimmed(write), "part long, path string, documents long, ids long"), "tokens")
    # one row for each file
    return manifest.withColumn("base", F.sum("ids").over(Window.orderBy("part")) - F.col("ids"))


def read_tokens(manifest: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32 (of the ids as little-endian uint32), and the ids on request."""
    from strataweave.llm.storage import open_input

    out = T._parse_datatype_string(f"`{key}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"]) as f:
                    t = TokenFile(f)
                    for i, b in t.blocks():
                        ids = t.ids(int(b[0]), int(b[-1])).astype("<u4")
                        local = b - b[0]
                        crc = [zlib.crc32(ids[x:y].data) for x, y in zip(local[:-1], local[1:], strict=True)]
                        cols = [t.keys(i, i + len(b) - 1), pa.array(b[:-1] + row["base"]), pa.array(np.diff(b)), pa.array(crc, pa.int64())]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(local, pa.int32()), pa.array(ids.astype(np.int64))))
                        yield pa.RecordBatch.from_arrays(cols, names=out.names)

    files = manifest.select("path", "base", "part")
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(width, "part").mapInArrow(trimmed(read), out)


def token_folder(docs: DataFrame) -> str:
    from strataweave.llm.storage import fresh_folder

    return fresh_folder(shared_dir(docs.sparkSession), "tokens")


