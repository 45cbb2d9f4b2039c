"""Media columns: AVI motion-JPEG.

Reads RIFF structures (hdrl, movi, idx1, INFO), decodes baseline JPEG intra
frames and finds shots by histogram differences against an adaptive threshold.
The writer stores bytes without loss: each sample becomes one 8x8 block of a
grey frame that holds only a DC coefficient, with quantiser 8, so the block
decodes to that very sample. The frame's Huffman table gives category c a code
of 9 - c bits, so every DC difference takes 9 bits and the end of block one:
frames of this kind are packed and unpacked by whole arrays. Frames with other
tables go through the general baseline decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strataweave.llm.textblocks import trimmed

#: blocks in a row of the frames written, and rows at most: 1,024 samples, so that all but short texts have several frames
COLUMNS, ROWS = 64, 16
#: JPEG's zigzag order (fixed values: ITU-T T.81)
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


class MediaError(ValueError):
    """The bytes aren't a readable AVI or JPEG."""


# -- DC-only frames ------------------------------------------------------------------

def _dc_codes() -> tuple[np.ndarray, np.ndarray]:
    """9-bit code of each difference -255..255, and the difference of each code."""
    code, back = np.zeros(511, np.int64), np.full(512, 999, np.int64)
    prefix = 0
    for c in range(8, -1, -1):  # canonical codes: shortest first
        length = 9 - c
        for extra in range(1 << c):
            diff = 0 if c == 0 else extra if extra >> (c - 1) else extra - (1 << c) + 1
            bits = prefix << c | extra
            code[diff + 255], back[bits] = bits, diff
        prefix = (prefix + 1) << 1 if length < 9 else prefix
    return code, back


_CODE, _DIFF = _dc_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DHT = _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))) + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
_DQT = _segment(0xDB, b"\x00" + b"\x08" * 64)
_SOS = _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def encode_frame(samples: np.ndarray) -> bytes:
    """A grey baseline JPEG of (rows, columns) blocks; each 8x8 block shows one 8-bit sample."""
    rows, columns = samples.shape
    level = samples.ravel().astype(np.int64)
    diff = np.diff(level, prepend=128)
    n = len(diff)
    padded = np.zeros(-(-n // 4) * 4, np.int64)
    padded[:n] = _CODE[diff + 255] << 1  # the end of block is a 0 bit
    four = padded.reshape(-1, 4)
    word = four[:, 0] << 30 | four[:, 1] << 20 | four[:, 2] << 10 | four[:, 3]
    stream = word.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 3:].ravel()[: -(-n * 10 // 8)].copy()
    if spare := -n * 10 % 8:
        stream[-1] |= (1 << spare) - 1
    full = np.flatnonzero(stream == 255)
    if len(full):
        stream = np.insert(stream, full + 1, 0)
    sof = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + b"\x01\x11\x00")
    return b"\xff\xd8" + _DQT + sof + _DHT + _SOS + stream.tobytes() + b"\xff\xd9"


def _parse_jpeg(data: bytes) -> dict:
    if data[:2] != b"\xff\xd8":
        raise MediaError("no SOI marker")
    out: dict = {"q": {}, "h": {}, "restart": 0}
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise MediaError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["q"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (wide + 1)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (wide + 1) :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                total = sum(counts)
                out["h"][body[0]] = (bytes(counts), body[17 : 17 + total])
                body = body[17 + total :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, k = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise MediaError("only 8-bit samples are supported")
            out |= {"height": height, "width": width, "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]}
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and marker != 0xCC:
            raise MediaError("only baseline frames are supported")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            if "parts" not in out:
                raise MediaError("scan before frame header")
            out["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            out["data"] = data[at + 2 + size :]
            return out
        at += 2 + size
    raise MediaError("no scan")


def _is_dc_only(j: dict) -> bool:
    return len(j["parts"]) == 1 and not j["restart"] and (j["q"].get(j["parts"][0][3]) == 8).all() and j["h"].get(0) == (bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))) and j["h"].get(16) == (bytes([1] + [0] * 15), b"\x00")


def decode_samples(data: bytes) -> np.ndarray:
    """The samples of a DC-only frame, one for each block."""
    j = _parse_jpeg(data)
    if not _is_dc_only(j):
        raise MediaError("not a frame of single DC coefficients")
    rows, columns = -(-j["height"] // 8), -(-j["width"] // 8)
    n = rows * columns
    stream = np.frombuffer(j["data"], np.uint8)
    stuffed = np.flatnonzero(stream[:-1] == 255)
    stuffed = stuffed[stream[stuffed + 1] == 0] + 1
    stream = np.delete(stream, stuffed)[: -(-n * 10 // 8)]
    if len(stream) < -(-n * 10 // 8):
        raise MediaError("the scan is cut short")
    whole = np.zeros(-(-n // 4) * 5, np.int64)
    whole[: len(stream)] = stream
    five = whole.reshape(-1, 5)
    word = five[:, 0] << 32 | five[:, 1] << 24 | five[:, 2] << 16 | five[:, 3] << 8 | five[:, 4]
    codes = np.stack([word >> 31 & 511, word >> 21 & 511, word >> 11 & 511, word >> 1 & 511], 1).ravel()[:n]
    level = 128 + np.cumsum(_DIFF[codes])
    if ((level < 0) | (level > 255)).any():
        raise MediaError("a sample is out of range")
    return level.astype(np.uint8).reshape(rows, columns)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.value = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            if byte == 0xFF and self.at + 1 < len(self.data):
                if self.data[self.at + 1] == 0:
                    self.at += 1
                else:
                    byte = 0
                    self.at -= 1  # a marker: pad with zeros
            self.at += 1
            self.value = (self.value << 8 | byte) & 0xFFFFFFFF
            self.left += 8
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def restart(self) -> None:
        self.left = 0
        at = self.data.find(b"\xff", self.at)
        while at >= 0 and not 0xD0 <= self.data[at + 1 : at + 2][0] <= 0xD7:
            at = self.data.find(b"\xff", at + 1)
        if at < 0:
            raise MediaError("a restart marker is missing")
        self.at = at + 2


def _lookup(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    codes, code, k = {}, 0, 0
    for length, count in enumerate(table[0], 1):
        for _ in range(count):
            codes[length, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def _symbol(bits: _Bits, codes: dict[tuple[int, int], int]) -> int:
    code = 0
    for length in range(1, 17):
        code = code << 1 | bits.take(1)
        if (length, code) in codes:
            return codes[length, code]
    raise MediaError("a code is not in the table")


def _extend(bits: _Bits, n: int) -> int:
    if not n:
        return 0
    v = bits.take(n)
    return v if v >> (n - 1) else v - (1 << n) + 1


_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def decode_luma(data: bytes) -> np.ndarray:
    """The first component of a baseline frame (grey or luma), as (height, width) uint8."""
    j = _parse_jpeg(data)
    if _is_dc_only(j):
        return np.kron(decode_samples(data), np.ones((8, 8), np.uint8))[: j["height"], : j["width"]]
    parts = j["parts"]
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, wide, high = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-j["width"] // (8 * wide)), -(-j["height"] // (8 * high))
    tables = {k: _lookup(v) for k, v in j["h"].items()}
    bits, before = _Bits(j["data"]), dict.fromkeys([p[0] for p in parts], 0)
    ident, fx, fy, quant = parts[0]
    plane = np.zeros((down * fy, across * fx, 64), np.int64)
    for mcu in range(across * down):
        if j["restart"] and mcu and mcu % j["restart"] == 0:
            bits.restart()
            before = dict.fromkeys(before, 0)
        for part, px, py, _ in parts:
            dc, ac = (tables.get(t) for t in (j["scan"][part][0], 16 + j["scan"][part][1]))
            if dc is None or ac is None:
                raise MediaError("a Huffman table is missing")
            for by in range(py):
                for bx in range(px):
                    block = np.zeros(64, np.int64)
                    before[part] += _extend(bits, _symbol(bits, dc))
                    block[0] = before[part]
                    k = 1
                    while k < 64:
                        s = _symbol(bits, ac)
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            if k > 63:
                                raise MediaError("a block is too long")
                            block[k] = _extend(bits, s & 15)
                        k += 1
                    if part == ident:
                        plane[mcu // across * fy + by, mcu % across * fx + bx] = block
    plane *= j["q"][quant]
    freq = np.zeros_like(plane)
    freq[..., ZIGZAG] = plane
    pixels = np.einsum("ux,abuv,vy->abxy", _DCT, freq.reshape(*plane.shape[:2], 8, 8).astype(float), _DCT)
    shown = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
    return shown.transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, -1)[: -(-j["height"] * fy // high), : -(-j["width"] * fx // wide)]


# -- RIFF ----------------------------------------------------------------------------

def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(chunks))


def write_avi(frames: list[bytes], width: int, height: int, rate: int = 25, note: str = "") -> bytes:
    """An AVI 1.0 file with one motion-JPEG stream, an idx1 index and ``note`` as INFO/ICMT."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf)))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    body = b"AVI " + hdrl + _list(b"INFO", _chunk(b"ICMT", note.encode())) + _list(b"movi", *(_chunk(b"00dc", f) for f in frames)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> dict:
    """width, height, rate (frames a second), note and the frames' bytes.

    Frames come by idx1 where its entries point at chunks of the stream (offsets
    from the movi list or from the file's start), else by walking movi.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise MediaError("not a RIFF AVI file")
    out: dict = {"frames": [], "note": "", "rate": 25.0, "width": 0, "height": 0}
    movi, idx = None, b""
    for name, a, b in _walk(data, 12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0])):
        kind = data[a : a + 4]
        if name == b"LIST" and kind == b"hdrl":
            for n2, a2, _ in _walk(data, a + 4, b):
                if n2 == b"avih" and (us := struct.unpack("<I", data[a2 : a2 + 4])[0]):
                    out["rate"] = 1_000_000 / us
                    out["width"], out["height"] = struct.unpack("<II", data[a2 + 32 : a2 + 40])
        elif name == b"LIST" and kind == b"INFO":
            for n2, a2, b2 in _walk(data, a + 4, b):
                if n2 == b"ICMT":
                    out["note"] = data[a2:b2].decode("utf-8", "replace")
        elif name == b"LIST" and kind == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            idx = data[a:b]
    if movi is None:
        raise MediaError("no movi list")
    entries = [struct.unpack("<4sIII", idx[i : i + 16]) for i in range(0, len(idx) - 15, 16)]
    entries = [e for e in entries if e[0][2:] in (b"dc", b"db")]
    for base in (movi[0], 0):
        if entries and all(data[base + o : base + o + 4] == name and base + o + 8 + size <= len(data) for name, _, o, size in entries):
            out["frames"] = [data[base + o + 8 : base + o + 8 + size] for _, _, o, size in entries]
            return out
    out["frames"] = [data[a:b] for name, a, b in _walk(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    return out


# -- shots ---------------------------------------------------------------------------

def shots(histograms: np.ndarray, window: int = 8, factor: float = 3.0, floor: float = 0.25) -> list[tuple[int, int]]:
    """Half-open frame ranges of shots.

    Between neighbours stands half the L1 distance of their normalised histograms; a
    cut is a distance above ``floor`` and above mean + factor * deviation of the
    ``window`` distances before it within its shot (none: the floor alone).
    """
    if not len(histograms):
        return []
    h = histograms / np.maximum(histograms.sum(1, keepdims=True), 1)
    d = np.abs(np.diff(h, axis=0)).sum(1) / 2
    begin, out = 0, []
    for i, x in enumerate(d):
        past = d[max(begin, i - window) : i]
        if x > floor and (not len(past) or x > past.mean() + factor * past.std()):
            out.append((begin, i + 1))
            begin = i + 1
    return [*out, (begin, len(histograms))]


def payload_to_avi(payload: bytes) -> bytes:
    """Bytes as an AVI file; frames have at most ``ROWS`` x ``COLUMNS`` samples, the last is padded with 0."""
    n = len(payload)
    total = max(1, -(-n // COLUMNS))
    count = -(-total // ROWS)
    rows = -(-total // count)
    samples = np.zeros(count * rows * COLUMNS, np.uint8)
    samples[:n] = np.frombuffer(payload, np.uint8)
    frames = [encode_frame(f) for f in samples.reshape(count, rows, COLUMNS)]
    return write_avi(frames, COLUMNS * 8, rows * 8, note=f"payload_bytes={n}")


def avi_to_payload(data: bytes) -> tuple[bytes, list[np.ndarray], dict]:
    """The stored bytes, the frames' samples, and what ``read_avi`` gives."""
    avi = read_avi(data)
    frames = [decode_samples(f) for f in avi["frames"]]
    n = int(avi["note"].removeprefix("payload_bytes="))
    payload = np.concatenate([f.ravel() for f in frames]).tobytes()[:n]
    if len(payload) < n:
        raise MediaError("frames are missing")
    return payload, frames, avi


def padded_payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\x00" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip:int,first_frame:int,n_frames:int,start_s:double,end_s:double>>"


def payload_histograms(frames: list[np.ndarray], n: int) -> np.ndarray:
    """64-bin histograms of the frames' samples up to the n-th: what pads the last frame doesn't count."""
    flat = np.concatenate([f.ravel() for f in frames])[:n] >> 2
    frame = np.arange(n) // frames[0].size
    return np.bincount(frame * 64 + flat, minlength=64 * len(frames)).reshape(-1, 64)


def timed_clips(histograms: np.ndarray, rate: float) -> list[dict]:
    """The shots as clips with times in seconds."""
    return [{"clip": i, "first_frame": a, "n_frames": b - a, "start_s": a / rate, "end_s": b / rate} for i, (a, b) in enumerate(shots(histograms))]


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Store every whole text as AVI motion-JPEG, read it back and compute features and clips.

    Null and empty texts store 64 zero bytes. Equal texts have equal rows, and repeated rows stay; an empty
    table gives none; other columns are not read. ``with_media`` adds the files.
    feature: frames, shots, and mean sample and mean histogram difference of the frames. clips: the shots with their times.
    """
    schema = T.StructType([docs.schema[key]] + list(T._parse_datatype_string(_DIGEST).fields) + ([T.StructField("media", T.BinaryType())] if with_media else []))
    clip = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataweave.llm.textblocks import pieces

        for batch in pieces(batches, text, 2 << 20):
            rows = []
            for value in batch.column(text):
                payload, n = padded_payload(value.as_py())
                media = payload_to_avi(payload)
                back, frames, avi = avi_to_payload(media)
                hist = payload_histograms(frames, len(back))
                found = timed_clips(hist, avi["rate"])
                share = hist / hist.sum(1, keepdims=True)
                step = float(np.abs(np.diff(share, axis=0)).sum() / (2 * max(1, len(hist) - 1)))
                feature = f"frames={len(frames)};shots={len(found)};seconds={len(frames) / avi['rate']:.3f};mean={np.frombuffer(back, np.uint8).mean():.4f};step={step:.4f}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, found) + ((media,) if with_media else ()))
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False))], names=schema.names)

    return docs.select(key, text).mapInArrow(trimmed(run), schema)


def clips(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """Timed clip rows of AVI files: key, clip, first_frame, n_frames, start_s, end_s, error.

    Frames are decoded to luma. Unreadable files and null give one row with ``error`` and no clip; repeated rows give their clips
    again; an empty table gives none; other columns are not read.
    """
    schema = T.StructType([media.schema[key]] + list(T._parse_datatype_string("clip int, first_frame int, n_frames int, start_s double, end_s double, error string").fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, value in zip(batch.column(key).to_pylist(), batch.column(column), strict=True):
                try:
                    avi = read_avi(value.as_py() or b"")
                    hist = [np.bincount(decode_luma(f).ravel() >> 2, minlength=64) for f in avi["frames"]]
                    rows += [(k, i, a, b - a, a / avi["rate"], b / avi["rate"], None) for i, (a, b) in enumerate(shots(np.array(hist).reshape(-1, 64)))]
                except (MediaError, struct.error, IndexError, KeyError) as e:
                    rows.append((k, None, None, None, None, None, str(e) or type(e).__name__))
            kinds = [batch.schema.field(key).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=schema.names)

    return media.select(key, column).mapInArrow(trimmed(run), schema)
