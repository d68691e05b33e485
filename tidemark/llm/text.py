"""Whole-batch NumPy views of UTF-8 texts: words, their hashes, and sets of hashed word shingles.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.  A batch
is cut into chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own), so memory follows the longest text,
not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 21

#: Byte spans over so many bytes are hashed one by one.
LONG = 256

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIZED = np.uint64(0xA24BAED4963EE407)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one whole number, with zero bytes after the end."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def _low(words: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The words with only their first ``size`` (1 to 8) bytes."""
    return words & (np.uint64((1 << 64) - 1) >> (np.uint64(64) - np.uint64(8) * np.asarray(size).astype(np.uint64)))


def spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal for equal bytes wherever they stand.

    Eight bytes at a time go through a full mixer, for all spans at once; long spans go through XXH3 one by one.
    """
    size = ends - starts
    at = _loads(buf)
    out = mix(size.astype(np.uint64) * _SIZED)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    for k in range(0, LONG, 8):
        if not len(live):
            break
        left = size[live] - k
        out[live] = mix(out[live] ^ _low(at[starts[live] + k], np.minimum(left, 8)))
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]])
    return out


def windows(buf: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the ``width`` bytes from each place on, where so many are left."""
    n = max(0, len(buf) - width + 1)
    at = np.ascontiguousarray(_loads(buf))
    out = np.full(n, width + (seed << 32), np.uint64)
    for k in range(0, width, 8):
        word = at[k : k + n]
        out = mix(out ^ (word if width - k >= 8 else _low(word, width - k)))
    return out


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (first, last, bytes, bounds) of texts; bounds has last - first + 1 offsets into bytes.  Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more at the end)."""
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], word))
    after = np.concatenate((word, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, bounds)


def shingle_sets(
    buf: np.ndarray, bounds: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sorted distinct hashes of its lower-cased word shingles, one after the other, and their bounds.

    A text with fewer words than ``width`` has its whole sequence as its one shingle; without words it has none.
    """
    starts, ends, first = words(buf, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    hashed = spans(_LOWER[buf], starts, ends)
    counts = np.diff(first)
    rolled = hashed * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(1, width):
        shifted = np.zeros_like(hashed)
        shifted[:-k] = hashed[k:]
        rolled = mix(rolled) + shifted
    rolled = mix(rolled)
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(number, out=out[1:])
    take = np.repeat(first[:-1] - out[:-1], number) + np.arange(out[-1])
    got = rolled[take]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.uint64(counts[i])
        for x in hashed[first[i] : first[i + 1]]:
            h = mix(np.array([h ^ x], np.uint64))[0]
        got[out[i]] = h
    for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True):
        got[a:b].sort()
    new = np.ones(len(got), bool)
    new[1:] = got[1:] != got[:-1]
    new[out[:-1][number > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return got[new], kept[out]
