"""Vectorised word and shingle hashes over UTF-8 bytes.

Hashes are 64-bit polynomials over random byte codes, modulo 2**64, with
mixed bits; the codes and the base are fixed, so that all workers agree.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed at once; longer texts are cut at separators.
RUN_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_JOIN = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers, well mixed (one to one)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_CODES = mix(np.arange(1, 257, dtype=U) * U(_BASE)) | U(1)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def byte_classes(separators: bytes) -> np.ndarray:
    """For each byte what it counts as: A-Z as a-z, separators as 0."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    lut[list(separators)] = 0
    return lut


#: Words are runs without ASCII white space. A null byte counts as 255, which
#: UTF-8 never has, as 0 marks separators.
SPACED = byte_classes(b"\x09\x0a\x0b\x0c\x0d\x20")
SPACED[0] = 255
#: Words are runs of ASCII letters, digits and all that is not ASCII.
ALNUM = byte_classes(bytes(b for b in range(128) if not chr(b).isalnum()))


@dataclass
class Words:
    """Words of consecutive texts: hashes and byte places in their own text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: words before each text, one more at the end
    first: np.ndarray


def _hash_run(data: np.ndarray, cuts: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in ``data``; texts begin at ``cuts``."""
    n = len(data)
    if not n:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    x = lut[data]
    word = x != 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    begins[inner] = word[inner]
    stops[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, inverse = _powers(max(RUN_BYTES * 2, 1 << (n - 1).bit_length()))
    sums = np.zeros(n + 1, U)
    np.cumsum(_CODES[x] * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U)), starts, ends


def _long_text(data: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + RUN_BYTES)
        while end < len(data) and (gap := np.flatnonzero(lut[data[at:end]] == 0)).size == 0:
            end = min(len(data), at + 2 * (end - at))  # a very long word
        if end < len(data):
            end = at + int(gap[-1]) + 1
        h, s, e = _hash_run(data[at:end], np.zeros(1, np.int64), lut)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(p) for p in zip(*parts))


def words(texts: pa.Array, lut: np.ndarray) -> Iterator[tuple[int, Words]]:
    """Hash the words of a string array, some rows at a time.

    Yields the first row and the words of consecutive rows. Null texts have
    no words. Rows come together up to ``RUN_BYTES``; a longer text alone.
    """
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN_BYTES, "right")) - 1)
        hi = min(hi, n)
        run, cuts = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if hi - lo == 1 and len(run) > RUN_BYTES:
            h, s, e = _long_text(run, lut)
            yield lo, Words(h, s, e, np.array([0, len(h)]))
        else:
            h, s, e = _hash_run(run, cuts[:-1], lut)
            first = np.searchsorted(s, cuts)
            own = np.repeat(cuts[:-1], np.diff(first))
            yield lo, Words(h, s - own, e - own, first)
        lo = hi


def join_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, by their first word."""
    if len(hashes) < k:
        return np.empty(0, U)
    n = len(hashes) - k + 1
    out = hashes[:n] + U(k)
    for i in range(1, k):
        out = mix(out * _JOIN + hashes[i : i + n])
    return out


def rolling_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k consecutive words, by their first word.

    Each follows from the one before: a polynomial over the words' hashes,
    from running sums.
    """
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, U)
    power, inverse = _powers(max(RUN_BYTES * 2, 1 << len(hashes).bit_length()))
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n])


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles.

    A text of fewer words has its whole sequence as the one shingle; a text
    without words has none.
    """
    grams = join_hashes(w.hashes, k)
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if hi - lo >= k:
            yield np.unique(grams[lo : hi - k + 1])
        else:
            yield join_hashes(w.hashes[lo:hi], hi - lo) if hi > lo else np.empty(0, U)
