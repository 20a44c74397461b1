"""A wavelet matrix of a sequence of numbers: bit planes with rank and select, shaped by the numbers' frequencies.

Numbers get Huffman codes, and plane k holds the k-th code bit of the numbers whose code is that long. After each plane
the numbers with a zero go before those with a one, each in their old order; codes are dealt so that numbers whose code
ends lie last and are left off. All planes together take about as many bits as the entropy of the sequence.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"RFWM2\0"
#: Words of 64 bits between two notes of how many ones came before.
STRETCH = 8
STRETCH_BITS = 64 * STRETCH


class Bits:
    """A bit vector in 64-bit words, with the ones before each stretch of 512 bits. Questions come as arrays."""

    def __init__(self, n: int, words: np.ndarray, ones: np.ndarray):
        self.n, self.words, self.ones = n, words, ones

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        packed = np.packbits(bits, bitorder="little")
        stretches = len(bits) // STRETCH_BITS + 1
        raw = np.zeros(stretches * STRETCH_BITS // 8, np.uint8)
        raw[: len(packed)] = packed
        words = raw.view("<u8")
        own = np.bitwise_count(words).reshape(-1, STRETCH).sum(1, dtype=np.int64)
        return cls(len(bits), words, (np.cumsum(own) - own).astype("<i8"))

    def to_bytes(self) -> bytes:
        return struct.pack("<Q", self.n) + self.words.tobytes() + self.ones.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> tuple[Bits, int]:
        """(the bit vector, bytes read)."""
        (n,) = struct.unpack_from("<Q", raw)
        stretches = n // STRETCH_BITS + 1
        words = np.frombuffer(raw, "<u8", stretches * STRETCH, 8)
        return cls(n, words, np.frombuffer(raw, "<i8", stretches, 8 + words.nbytes)), 8 + words.nbytes + 8 * stretches

    def whole(self) -> np.ndarray:
        """Every bit."""
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(np.bool_)

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit, ones before it) of each position from 0 to n; the bit at n is 0."""
        word, offset = at >> 6, (at & 63).astype(np.uint64)
        mark = word // STRETCH
        rank = self.ones[mark].astype(np.int64)
        for k in range(STRETCH - 1):
            earlier = mark * STRETCH + k
            rank += np.where(earlier < word, np.bitwise_count(self.words[earlier]), 0).astype(np.int64)
        value = self.words[word]
        rank += np.bitwise_count(value & ((np.uint64(1) << offset) - np.uint64(1))).astype(np.int64)
        return (value >> offset & np.uint64(1)).astype(np.int64), rank

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """The position of the k-th (from 0) zero or one; there must be as many."""
        seen = self.ones if bit else np.arange(len(self.ones)) * STRETCH_BITS - self.ones
        mark = np.searchsorted(seen, k, side="right") - 1
        left = k - seen[mark]
        word = mark * STRETCH
        for _ in range(STRETCH - 1):
            own = np.bitwise_count(self.words[word]).astype(np.int64)
            own = own if bit else 64 - own
            on = left >= own
            on &= word % STRETCH < STRETCH - 1
            left, word = np.where(on, left - own, left), word + on
        value = self.words[word] if bit else ~self.words[word]
        at = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = value >> at.astype(np.uint64) & np.uint64((1 << half) - 1)
            own = np.bitwise_count(low).astype(np.int64)
            on = left >= own
            left, at = np.where(on, left - own, left), at + half * on
        return word * 64 + at


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of a Huffman code for numbers with these counts, in ascending order: two queues, the lesser head first."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    leaves, joined, parent = counts.tolist(), [], [0] * (2 * n - 1)
    a = b = 0
    for node in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if a < n and (b >= len(joined) or leaves[a] <= joined[b]):
                child, total, a = a, total + leaves[a], a + 1
            else:
                child, total, b = n + b, total + joined[b], b + 1
            parent[child] = node
        joined.append(total)
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return np.array(depth[:n], np.int64)


def codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each number, first bit lowest; within a plane's order, codes that end come last, as they are given."""
    out = np.zeros(len(lengths), np.uint64)
    nodes = np.zeros(1, np.uint64)
    for level in range(1, int(lengths.max(initial=0)) + 1):
        nodes = np.concatenate((nodes, nodes | np.uint64(1 << (level - 1))))
        ending = np.flatnonzero(lengths == level)
        keep = len(nodes) - len(ending)
        if len(lengths) == 1:
            keep = 0
        out[ending] = nodes[keep : keep + len(ending)]
        nodes = nodes[:keep]
    return out


class WaveletMatrix:
    """Planes, and for each the numbers whose code ends there, in the order in which they lie at its end."""

    def __init__(self, n: int, numbers: np.ndarray, counts: np.ndarray, lengths: np.ndarray, planes: list[Bits]):
        self.n, self.numbers, self.counts, self.lengths, self.planes = n, numbers, counts, lengths, planes
        self.zeros = [plane.n - int(plane.look(np.array([plane.n]))[1][0]) for plane in planes]

    @classmethod
    def of(cls, sequence: np.ndarray) -> WaveletMatrix:
        """For a sequence of numbers from 0 on, below some millions."""
        every = np.bincount(sequence)
        numbers = np.flatnonzero(every)
        numbers = numbers[np.argsort(every[numbers], kind="stable")]
        counts = every[numbers]
        lengths = code_lengths(counts)
        table = np.zeros(len(every), np.uint64)
        table[numbers] = codes(lengths)
        if int(lengths.max(initial=0)) <= 32:
            table = table.astype(np.uint32)
        now, planes = table[sequence], []
        ends = np.bincount(lengths, weights=counts, minlength=1).astype(np.int64)
        for level in range(1, len(ends)):
            bits = (now & table.dtype.type(1)).astype(np.bool_)
            planes.append(Bits.of(bits))
            now = now >> table.dtype.type(1)
            # places and then a take: several times faster than a mask
            now = now.take(np.concatenate((np.flatnonzero(~bits), np.flatnonzero(bits)))[: len(now) - ends[level]])
        return cls(len(sequence), numbers, counts, lengths, planes)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQ", self.n, len(self.numbers), len(self.planes))
        columns = ((self.numbers, "<u4"), (self.counts, "<u8"), (self.lengths, "u1"))
        table = b"".join(x.astype(kind).tobytes() for x, kind in columns)
        return MAGIC + head + table + b"".join(plane.to_bytes() for plane in self.planes)

    @classmethod
    def from_bytes(cls, raw: bytes | memoryview) -> WaveletMatrix:
        raw = memoryview(raw)
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, different, levels = struct.unpack_from("<QQQ", raw, len(MAGIC))
        at, table = len(MAGIC) + 24, []
        for kind in ("<u4", "<u8", "u1"):
            table.append(np.frombuffer(raw, kind, different, at).astype(np.int64))
            at += table[-1].size * np.dtype(kind).itemsize
        planes = []
        for _ in range(levels):
            plane, size = Bits.from_bytes(raw[at:])
            planes.append(plane)
            at += size
        return cls(n, *table, planes)

    def whole(self) -> np.ndarray:
        """The sequence, undone plane by plane from the last."""
        now = np.empty(0, np.uint32)
        for level in range(len(self.planes), 0, -1):
            own = np.flatnonzero(self.lengths == level)
            below = np.concatenate((now, np.repeat(self.numbers[own].astype(np.uint32), self.counts[own])))
            bits = self.planes[level - 1].whole()
            zero = self.zeros[level - 1]
            now = np.empty(len(bits), np.uint32)
            now[np.flatnonzero(~bits)] = below[:zero]
            now[np.flatnonzero(bits)] = below[zero:]
        return now

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at some positions."""
        at = np.asarray(at, np.int64)
        out, live = np.zeros(len(at), np.int64), np.arange(len(at))
        for level, (plane, zero) in enumerate(zip(self.planes, self.zeros), 1):
            bit, ones = plane.look(at)
            at = np.where(bit == 1, zero + ones, at - ones)
            left = self.planes[level].n if level < len(self.planes) else 0
            done = at >= left
            if done.any():
                own = np.flatnonzero(self.lengths == level)
                starts = left + np.cumsum(self.counts[own]) - self.counts[own]
                out[live[done]] = self.numbers[own[np.searchsorted(starts, at[done], side="right") - 1]]
                live, at = live[~done], at[~done]
        return out

    def _code(self, number: int) -> tuple[int, int] | None:
        """(code, its length), or None for a number that does not occur."""
        found = np.flatnonzero(self.numbers == number)
        if not len(found):
            return None
        return int(codes(self.lengths)[found[0]]), int(self.lengths[found[0]])

    def _descend(self, code: int, length: int, at: np.ndarray) -> np.ndarray:
        for level in range(length):
            ones = self.planes[level].look(at)[1]
            at = self.zeros[level] + ones if code >> level & 1 else at - ones
        return at

    def count(self, number: int, low: int = 0, high: int | None = None) -> int:
        """How often a number occurs from position `low` to before `high`."""
        found = self._code(number)
        if found is None:
            return 0
        ends = self._descend(*found, np.array([low, self.n if high is None else high], np.int64))
        return int(ends[1] - ends[0])

    def occurrences(self, number: int) -> np.ndarray:
        """Every position of a number, in order: its last places are neighbours, and select leads them up again."""
        found = self._code(number)
        if found is None:
            return np.empty(0, np.int64)
        code, length = found
        first, end = self._descend(code, length, np.array([0, self.n], np.int64)).tolist()
        at = np.arange(first, end)
        for level in range(length - 1, -1, -1):
            plane = self.planes[level]
            at = plane.select(1, at - self.zeros[level]) if code >> level & 1 else plane.select(0, at)
        return at
