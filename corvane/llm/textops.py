"""Vectorised word and shingle hashing over batches of UTF-8 text.

Words are runs of bytes other than the six ASCII white-space bytes; A-Z count as a-z. Hashes are 64-bit
polynomial prefix sums with a seeded byte table, so that a batch costs a fixed number of numpy passes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_TABLE[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_WORD_COEFF = _rng.integers(1, 2**63, 8, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SHINGLE = 5
CHUNK_BYTES = 2 << 20

_powers = (np.ones(1, U), np.ones(1, U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        forward, back = np.full(size, _BASE, U), np.full(size, _BASE_INV, U)
        forward[0] = back[0] = 1
        _powers = (np.cumprod(forward), np.cumprod(back))
    return _powers


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h + U((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, bytes, row offsets) for runs of rows of about max_bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and offsets of each row's words among them."""
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and offsets of each row's words."""
    starts, ends, rows = word_spans(data, offsets)
    forward, back = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * forward[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U)), rows


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """Yields (row, sorted distinct shingle hashes); fewer than size words make one shingle, none make none."""
    for row, data, offsets in text_chunks(texts):
        words, rows = word_hashes(data, offsets)
        n = len(words)
        acc = np.zeros(n, U)
        for k in range(size):
            acc[: max(0, n - k)] += words[k:] * _WORD_COEFF[k]
        full = mix(acc, 1)
        for i in range(len(offsets) - 1):
            a, b = rows[i], rows[i + 1]
            if b - a >= size:
                yield row + i, np.unique(full[a : b - size + 1])
            elif b > a:
                short = (words[a:b] * _WORD_COEFF[: b - a]).sum(dtype=U) + U(b - a)
                yield row + i, mix(np.array([short], U), 2)
            else:
                yield row + i, np.zeros(0, U)


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit values that stand for a set."""
    if not len(shingles):
        return 0, 0
    one, two = mix(shingles, 3).sum(dtype=U), np.bitwise_xor.reduce(mix(shingles, 4))
    return int(np.int64(one.astype(np.int64))), int(np.int64(two.astype(np.int64)))
