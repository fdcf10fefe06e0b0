"""Vectorised kernels over the bytes of Arrow string columns.

A batch of texts is one byte array with offsets; nothing here loops over
texts or words in Python. Hashes are polynomials modulo 2**64 with odd bases,
taken from prefix sums and finished with a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BLOCK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of ``base`` and of its inverse, kept and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(_BLOCK, n) + 1
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: close inputs get unrelated outputs."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; a null has none."""
    return np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)


def cuts(size: np.ndarray, limit: int, rows: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes, one row at least and ``rows`` at most."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + limit, "right"))))
        yield at, to
        at = to


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text."""
    for low, high in cuts(sizes(batch.column(column)), limit, rows):
        yield batch.slice(low, high - low)


def byte_class(pattern_bytes: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    return table


#: Words that ASCII white space separates.
SPACED = ~byte_class(b" \t\n\x0b\x0c\r")
#: Words of ASCII letters and digits and of every character beyond ASCII.
ALNUM = byte_class(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
#: A-Z to a-z, the rest as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words of each text."""
    n_texts = len(offsets) - 1
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(n_texts, np.int64)
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    upto = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(upto)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each span of bytes (spans ascend and do not overlap)."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        lo, hi = starts[at], ends[to - 1]
        out[at:to] = range_hashes(data[lo:hi], starts[at:to] - lo, ends[at:to] - lo, base)
        at = to
    return out


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each range of ``values`` (unsigned integers)."""
    up, down = powers(len(values), base)
    total = np.zeros(len(values) + 1, U64)
    term = values.astype(U64)
    term += U64(1)
    term *= up[: len(values)]
    np.cumsum(term, out=total[1:])
    h = total[ends]
    h -= total[starts]
    h *= down[starts]
    h += (ends - starts).astype(U64)
    return mix(h)


def gather(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, end to end."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    out -= np.repeat(np.cumsum(counts) - counts, counts)
    return out


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a range that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0
