"""Whole batches of texts as byte arrays: word bounds, rolling hashes and shingles in numpy.

A text column of an Arrow batch is already one byte buffer with offsets, so nothing here makes Python strings.
Work goes in blocks of 128 KB (one longer text is a block of its own), so that the arrays stay in the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

BLOCK_BYTES = 1 << 17
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_SEEDED = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, and the same with A-Z read as a-z.
BYTE_VALUES = _SEEDED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, *range(9, 14)]] = True
SHINGLE_WORDS = 5
_SHINGLE_FACTORS = _SEEDED.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept by the worker and grown when needed."""
    if base not in _POWERS or len(_POWERS[base]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        table = np.cumprod(factors)
        if size > 512 * BLOCK_BYTES:
            return table
        _POWERS[base] = table
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off.astype(np.int64)


def blocks(raw: np.ndarray, off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of consecutive blocks of whole texts."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def squeezed(column: pa.Array) -> pa.Array:
    """Texts compressed one by one, for those that move between tasks: smaller than in the shuffle's own blocks."""
    raw, off = buffers(column)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    null = column.is_null().to_pylist() if column.null_count else [False] * len(column)
    return pa.array([None if none else squeeze(raw[a:b].tobytes()) for none, a, b in zip(null, off, off[1:], strict=False)], pa.binary())


def expanded(column: pa.Array) -> list[bytes]:
    """The texts of a column of compressed ones; nulls are empty."""
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(t) if t is not None else b"" for t in column.to_pylist()]


def expanded_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches with their compressed column ``text`` opened, cut where their texts pass ``limit`` bytes (one longer text
    is a batch of its own)."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        sizes = [zstandard.frame_content_size(t) if t is not None else 0 for t in batch.column(at).to_pylist()]
        ends = np.cumsum([0, *sizes])
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
            part = batch.slice(i, j - i)
            yield part.set_column(at, "text", pa.array(expanded(part.column(at)), pa.large_binary()))
            i = j


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """C with C[i] the weighted sum of the first i bytes: a substring's hash is (C[e] - C[s]) / MULTIPLIER**s."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(MULTIPLIER, len(data))[: len(data)], out=out[1:])
    return out


def word_sums(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """C with C[e] - C[s] a hash of the bytes s to e of a word that starts at s, an entry of ``starts`` (ascending).

    Every byte adds a mixed value of itself and its place in the word, so no pattern of letters cancels out as it does in
    a polynomial modulo 2**64.
    """
    step = np.zeros(len(data), np.int64)
    if len(starts):
        step[starts] = np.diff(starts, prepend=0)
    place = (np.arange(len(data)) - np.cumsum(step)).astype(np.uint64)
    x = values[data] + place * np.uint64(MULTIPLIER)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def word_bounds(data: np.ndarray, off: np.ndarray, blank: np.ndarray = IS_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and for each text the index of its first word (n + 1 values)."""
    inside = ~blank[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of all texts (A-Z folded) and the text of each.

    A text of 1 to 4 words has one shingle, of all its words; a text without words has none.
    """
    s, e, first = word_bounds(data, off)
    sums = word_sums(data, s, FOLDED_VALUES)
    words = mix(sums[e] - sums[s])
    count = np.diff(first)
    n = len(words)
    out = np.zeros(max(n - SHINGLE_WORDS + 1, 0), np.uint64)
    for j, f in enumerate(_SHINGLE_FACTORS):
        out += words[j : n - SHINGLE_WORDS + 1 + j] * f if len(out) else out
    text = np.repeat(np.arange(len(count)), count)
    whole = text[: len(out)] == text[SHINGLE_WORDS - 1 :][: len(out)]
    out, of = out[whole], text[: len(out)][whole]
    few = np.flatnonzero((count > 0) & (count < SHINGLE_WORDS))
    if len(few):
        short = np.array(
            [sum((int(words[first[t] + j]) * int(_SHINGLE_FACTORS[j]) for j in range(count[t])), int(count[t])) % (1 << 64) for t in few],
            np.uint64,
        )
        order = np.argsort(np.concatenate([of, few]), kind="stable")
        out, of = np.concatenate([out, short])[order], np.concatenate([of, few])[order]
    return mix(out), of


def counted(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with their number: hashes, texts (ascending) and counts."""
    if not len(hashes):
        return hashes, of, np.zeros(0, np.int64)
    order = np.lexsort((hashes, of))
    h, t = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))
