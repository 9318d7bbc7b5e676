"""Byte-level BPE encoding and decoding with a local rank file.

Token ids travel as binary columns of little-endian unsigned 32-bit
integers: four bytes a token, and a digest needs no conversion.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shoalwatch.llm.common import append_columns

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: Texts longer than this are encoded in pieces of about this many characters.
PIECE_CHARS = 1 << 18

# No match of the splitting pattern holds a space or newline after a visible
# ASCII character, and none looks behind; so such a place parts two matches.
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The tiktoken encoding of a rank file, one per worker process."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS):
    """Split a long text at places where the pattern splits it anyway.

    A run without such a place stays whole, however long it is.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode(text: str | None, ranks_path: str = RANKS) -> np.ndarray:
    """Token ids of one text; none for null and empty texts."""
    if not text:
        return np.empty(0, "<u4")
    own = encoding(ranks_path)
    if len(text) <= PIECE_CHARS:
        return np.array(own.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(own.encode_ordinary(piece), "<u4") for piece in pieces(text)])


def decode(ids: bytes | None, ranks_path: str = RANKS) -> bytes:
    """The raw bytes of packed ids; they need not be valid UTF-8."""
    own, packed = encoding(ranks_path), np.frombuffer(ids or b"", "<u4")
    return b"".join(own.decode_bytes(packed[i : i + PIECE_CHARS].tolist()) for i in range(0, len(packed), PIECE_CHARS))


def with_token_ids(df: DataFrame, text: str = "text", out: str = "token_ids", *, ranks_path: str = RANKS, keep: list[str] | None = None) -> DataFrame:
    """Add column ``out``: the packed ids of every whole text.

    Null and empty texts get empty ids; a clashing column is replaced; each
    row is encoded alone, so repeated rows and ties need no rule.
    """
    at = df.columns.index(text)

    def encoded(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array((encode(t.as_py(), ranks_path).tobytes() for t in batch.column(at)), pa.binary())]

    return append_columns(df, [(out, T.BinaryType())], encoded, keep)


def with_decoded(df: DataFrame, ids: str = "token_ids", out: str = "decoded", *, ranks_path: str = RANKS, keep: list[str] | None = None) -> DataFrame:
    """Add column ``out``: the bytes that packed ids stand for (null: none)."""
    at = df.columns.index(ids)

    def decoded(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array((decode(t.as_py(), ranks_path) for t in batch.column(at)), pa.binary())]

    return append_columns(df, [(out, T.BinaryType())], decoded, keep)


def with_round_trip(df: DataFrame, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", *, ranks_path: str = RANKS, keep: list[str] | None = None) -> DataFrame:
    """Add ``with_token_ids`` and ``with_decoded`` of it in one pass.

    One Python worker serves a task, where two chained passes take two.
    """
    at = df.columns.index(text)

    def both(batch: pa.RecordBatch) -> list[pa.Array]:
        packed = [encode(t.as_py(), ranks_path).tobytes() for t in batch.column(at)]
        return [pa.array(packed, pa.binary()), pa.array((decode(p, ranks_path) for p in packed), pa.binary())]

    return append_columns(df, [(ids, T.BinaryType()), (decoded, T.BinaryType())], both, keep)


def with_token_count(df: DataFrame, text: str = "text", out: str = "n_tokens", *, ranks_path: str = RANKS, keep: list[str] | None = None) -> DataFrame:
    """Add column ``out``: the number of tokens of every whole text (null: 0)."""
    at = df.columns.index(text)

    def counted(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array((len(encode(t.as_py(), ranks_path)) for t in batch.column(at)), pa.int64())]

    return append_columns(df, [(out, T.LongType())], counted, keep)
