r"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are split before the merges at safe boundaries: just before white
space that follows an ASCII letter, digit or sign. No match of the pattern
reaches from there into the white space, and the pattern looks only ahead, so
the pieces give the ids of the whole text. A text without such a place in
``PIECE`` characters stays in one piece up to the next one. Long runs of white
space are taken out as the single match that the pattern makes of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strataweave.llm.textblocks import trimmed

#: characters after which a piece ends at the next safe boundary
PIECE = 1 << 16
#: a run of so much white space is merged as the one match that it is: the regex engine would overflow its stack on long ones
RUN = 1 << 12
#: White_Space of Unicode, as in a character class (fixed values)
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SAFE = re.compile(r"(?<=[!-~])[ \n]")


class Codec:
    """Ranks, the encoder and a byte table for decoding."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local_ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str, piece: int = PIECE, run: int = RUN) -> list[int]:
        ids: list[int] = []
        at = 0
        if len(text) > run:
            for space in re.finditer(rf"[{SPACE}]{{{run},}}", text):
                ids += self._pieces(text[at : space.start()], piece)
                # the pattern leaves the last sign of a run to what follows it
                at = space.end() - (space.end() < len(text))
                ids += self.encoding._encode_single_piece(text[space.start() : at])
        return ids + self._pieces(text[at:], piece)

    def _pieces(self, text: str, piece: int) -> list[int]:
        if len(text) <= piece:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        while at < len(text):
            cut = _SAFE.search(text, at + piece)
            end = cut.start() if cut else len(text)
            ids += self.encoding.encode_ordinary(text[at:end])
            at = end
        return ids

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """The raw bytes; they need not be valid UTF-8."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker process and rank file."""
    return Codec(ranks_path, pattern)


def encode_tokens(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns the columns ``keep`` (default: all of docs but the text), then ids
    (array of int; absent with ``with_ids=False``), n_tokens, ids_sha256 (of the
    ids as little-endian uint32) and decoded_sha256 (of the decoded bytes).
    A null or empty text has no tokens. Repeated rows give repeated results;
    an empty table gives none. Columns of docs named like an output are dropped.
    Rows are independent: no shuffle, one Arrow batch in memory at a time.
    """
    out = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    out += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    names = {f.name for f in out}
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text and c not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataweave.llm.textblocks import pieces

        c = codec(ranks_path, pattern)
        for batch in pieces(batches, text, 2 << 20):
            ids, n, sha, back = [], [], [], []
            for value in batch.column(text):
                got = c.encode(value.as_py() or "")
                packed = np.array(got, "<u4")
                n.append(len(got))
                sha.append(hashlib.sha256(packed.tobytes()).hexdigest())
                back.append(hashlib.sha256(c.decode(got)).hexdigest())
                if with_ids:
                    ids.append(packed.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []) + [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                names=keep + [f.name for f in out],
            )

    return docs.select(*keep, text).mapInArrow(trimmed(run), schema)


def decode_tokens(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the raw bytes of an id array (null: null). An id outside the rank file is an error."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.BinaryType())])
    keep = [f.name for f in df.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            got = [None if v.as_py() is None else c.decode(v.as_py()) for v in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(got, pa.binary())], names=keep + [out])

    return df.select(*keep).mapInArrow(trimmed(run), schema)
