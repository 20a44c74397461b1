"""Vectorised work on the UTF-8 bytes of a batch of texts: slices, words and fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Fixed odd multipliers and seeds of the fingerprints.
M1, M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
LANE, STEP, SECOND = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
SLICE_BYTES = 1 << 20


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Membership of each byte value in the given closed ranges."""
    member = np.zeros(256, np.bool_)
    for low, high in ranges:
        member[low : high + 1] = True
    return member


#: Everything but ASCII white space.
NOT_SPACE = ~table((0x09, 0x0D), (0x20, 0x20))
#: Letters, digits and every byte beyond ASCII.
ALNUM = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Byte values with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * M1
    x = (x ^ (x >> U64(27))) * M2
    return x ^ (x >> U64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds of the rows in them): whole rows, about `limit` bytes at a time; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        at = 0
        for part in texts.chunks:
            for first, end, data, bounds in slices(part, limit):
                yield first + at, end + at, data, bounds
            at += len(part)
        return
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


def word_spans(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the words in bytes and the bounds of each row in words; words never cross rows."""
    inside = member[data]
    before = np.zeros(len(data), np.bool_)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), np.bool_)
    after[:-1] = inside[1:]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    last = bounds[1:][bounds[1:] > 0] - 1
    after[last] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each position, as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each span of bytes."""
    eight = lanes(data)
    size = (ends - starts).astype(np.int64)
    prints = mixed((size.astype(U64) + U64(seed)) * LANE)
    live = np.arange(len(starts))
    at, left = starts.astype(np.int64), size
    while len(live):
        x = eight[at]
        short = left < 8
        x = np.where(short, x & ((U64(1) << (np.minimum(left, 7).astype(U64) * U64(8))) - U64(1)), x)
        if len(live) == len(prints):
            prints = mixed(prints * STEP + x)
        else:
            prints[live] = mixed(prints[live] * STEP + x)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return prints


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[0].., starts[1].. of spans with the given sizes, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    full = sizes > 0
    starts, sizes = starts[full].astype(np.int64), sizes[full].astype(np.int64)
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    heads = np.cumsum(sizes)[:-1]
    step[heads] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(step)


def window_prints(prints: np.ndarray, length: int, factor: np.uint64 = LANE) -> np.ndarray:
    """A fingerprint of every `length` consecutive fingerprints, one for each start."""
    n = len(prints) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    total = prints[:n].copy()
    for k in range(1, length):
        total *= factor
        total += prints[k : k + n]
    return mixed(total)


def window_starts(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the windows that lie inside one row, and the row of each."""
    sizes = np.maximum(np.diff(bounds) - length + 1, 0)
    return ragged(bounds[:-1], sizes), np.repeat(np.arange(len(sizes)), sizes)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of the given length that starts at one of `starts`."""
    change = np.bincount(starts, minlength=n + 1).astype(np.int64)
    change -= np.bincount(np.minimum(starts + length, n), minlength=n + 1)
    return np.cumsum(change[:n]) > 0
