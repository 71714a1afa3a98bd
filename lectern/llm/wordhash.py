"""Words and word shingles of whole Arrow batches as 64-bit hashes, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer word makes a longer piece.
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: ASCII white space; every other byte belongs to a word.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The same and ASCII signs: words of letters, digits and bytes beyond ASCII.
SIGNS = np.ones(256, bool)
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def byte_values() -> np.ndarray:
    """A random 64-bit value for each byte, A-Z as a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    values[65:91] = values[97:123]
    return values


@cache
def powers() -> list[np.ndarray]:
    return [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers_to(n: int) -> list[np.ndarray]:
    """The powers of BASE and of INVERSE below `n`, modulo 2^64."""
    both = powers()
    if len(both[0]) < n:
        for k, factor in enumerate((BASE, INVERSE)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            both[k] = np.cumprod(steps, dtype=np.uint64)
    return both


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string array; nulls are empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


def word_spans(offsets: np.ndarray, data: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and next-to-last byte position of every word; no word crosses two texts."""
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (~after | edge[1:])) + 1


def word_hashes(texts: pa.Array, between: np.ndarray = SPACE, heads: list[tuple[int, list]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes not in `between`, A-Z lower-cased) and each text's first word.

    The second array has one more entry than there are texts. Equal words have equal hashes; different ones agree
    with a chance of about 2^-64. Each (n, list) of `heads` gets an array of the hashes of the words' first n bytes,
    with 0 for words that are not longer.
    """
    offsets, data = text_buffers(texts)
    starts, ends = word_spans(offsets, data, between)
    first = np.searchsorted(starts, offsets)
    hashes = np.empty(len(starts), np.uint64)
    for n, out in heads or ():
        out.append(np.zeros(len(starts), np.uint64))
    values = byte_values()
    k = 0
    while k < len(starts):
        low = starts[k]
        stop = max(k + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
        high = ends[stop - 1]
        up, down = powers_to(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[k:stop] - low, ends[k:stop] - low
        hashes[k:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        for n, out in heads or ():
            longer = np.flatnonzero(e - s > n)
            out[0][k + longer] = mix((sums[s[longer] + n] - sums[s[longer]]) * down[s[longer]] + np.uint64(n << 32))
        k = stop
    return hashes, first


def shingle_factors(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every `k` successive words."""
    factors = shingle_factors(k)
    n = len(hashes) - k + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        rolled += hashes[j : j + n] * factors[j]
    return mix(rolled + np.uint64(k)).view(np.int64)


def short_shingle(hashes: np.ndarray, k: int) -> np.ndarray:
    """The only shingle of a sequence of fewer than `k` words; none without words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    whole = np.sum(hashes * shingle_factors(k)[: len(hashes)], dtype=np.uint64) + np.uint64(len(hashes))
    return mix(np.array([whole])).view(np.int64)


def shingle_sets(texts: pa.Array, k: int):
    """For each text its set of distinct k-word shingles, sorted 64-bit integers; one short sequence is one shingle."""
    hashes, first = word_hashes(texts)
    rolled = rolling(hashes, k)
    for a, b in zip(first[:-1], first[1:]):
        yield np.unique(rolled[a : b - k + 1]) if b - a >= k else short_shingle(hashes[a:b], k)
