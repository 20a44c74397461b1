"""Questions from chunks of a corpus to key ranges and back, one bit for each answer.

A corpus is dealt into chunks of a few MB. Each chunk pre-aggregates what it wants to know about into sorted keys and
sends one blob of them to each range of the key space, a bucket. A bucket sees at most one entry of a key from each
chunk, however often the key occurs, so no key is hot. It answers each blob with one bit for each entry, in the order
asked, and the chunk, which works out the same keys again from its text, reads the bits off. The text itself moves
once: all steps read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.llm import textbytes as T

#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 4 << 20
U64 = np.uint64


def n_chunks(total_bytes: int) -> int:
    return max(1, -(-total_bytes // CHUNK_BYTES))


def dealt(source: DataFrame, chunks: int) -> DataFrame:
    """`source` (doc_id, text and perhaps carried) with `chunk`, partitioned by it.

    Id and text decide, so rows that share an id are spread as long as their texts differ.
    """
    return source.select(chunk_of(chunks, "doc_id", "text"), *source.columns).repartition("chunk")


def chunk_of(chunks: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(chunks)).alias("chunk")


#: A question: bucket, chunk, and columns of bytes; an answer: chunk, bucket and bits.
ASKED = "bucket int, chunk long, keys binary, rest binary"
ANSWERED = "chunk long, bucket int, bits binary"


def by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bounds of the buckets in sorted 64-bit keys: equal ranges of the key space."""
    width = (1 << 64) // buckets + 1 if buckets > 1 else 0
    edges = np.arange(buckets, dtype=U64) * U64(width)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _full(bounds: np.ndarray) -> list[int]:
    """The buckets that have a key."""
    return np.flatnonzero(bounds[1:] > bounds[:-1]).tolist()


def planes(x: np.ndarray) -> bytes:
    """Little-endian numbers byte by byte, so that equal high bytes lie together and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def gaps(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences."""
    return planes(np.diff(keys, prepend=U64(0)))


def ungaps(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, "<u8"), dtype=U64)


def questions(chunk: int, buckets: int, keys: np.ndarray, rest: Callable[[int, int], bytes], first: int = 0) -> dict:
    """Columns of ASKED for sorted keys; `rest(a, b)` gives what else goes with entries a to b."""
    bounds = by_bucket(keys, buckets)
    full = _full(bounds)
    return {
        "bucket": [first + b for b in full],
        "chunk": [chunk] * len(full),
        "keys": [gaps(keys[bounds[b] : bounds[b + 1]]) for b in full],
        "rest": [rest(bounds[b], bounds[b + 1]) for b in full],
    }


def asked(*parts: dict) -> pa.Table:
    joined = {name: [x for part in parts for x in part[name]] for name in ("bucket", "chunk", "keys", "rest")}
    return pa.table(
        {
            "bucket": pa.array(joined["bucket"], pa.int32()),
            "chunk": pa.array(joined["chunk"], pa.int64()),
            "keys": pa.array(joined["keys"], pa.binary()),
            "rest": pa.array(joined["rest"], pa.binary()),
        }
    )


def answered(rows: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    """The answers to the questions in `rows`, in their order."""
    return pa.table(
        {
            "chunk": rows.column("chunk"),
            "bucket": rows.column("bucket"),
            "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary()),
        }
    )


def answers(rows: pa.Table, first: int, buckets: int, keys: np.ndarray) -> np.ndarray:
    """The bit of each of the sorted keys, from the answers of buckets `first` to `first + buckets - 1`."""
    found = np.zeros(len(keys), np.bool_)
    if not rows.num_rows:
        return found
    bounds = by_bucket(keys, buckets)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist()):
        if first <= bucket < first + buckets:
            a, b = bounds[bucket - first], bounds[bucket - first + 1]
            found[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return found


class Sketch:
    """A count-min sketch, kept as the cells that each chunk has hit.

    A cell is a range of a rehash of the key, in each of `depth` rows; a chunk sends its cells and their counts. A
    bucket adds up a cell's counts over all chunks and answers which of `levels` the sum reaches. A key's estimate is
    the least of its cells, so it is never too low, and it is the same for every chunk that asks.
    """

    def __init__(self, n_keys: int, buckets: int, levels: tuple[int, ...] = (2,), depth: int = 2, per_key: int = 2):
        self.bits = max(10, int(n_keys * per_key - 1).bit_length()) if n_keys else 10
        self.buckets, self.levels, self.depth = buckets, tuple(sorted(levels)), depth
        #: A chunk's count stops at the highest level, where no question depends on it any more.
        self.count = np.min_scalar_type(self.levels[-1]).newbyteorder("<").str

    def _cells(self, row: int, keys: np.ndarray):
        """(sorted cells as the high bits of 64, the cell of each key)."""
        seed = U64(int(T.SECOND) * (2 * row + 1) % (1 << 64))
        cell = T.mixed(keys ^ seed) >> U64(64 - self.bits)
        order = np.argsort(cell)
        ordered = cell[order]
        head = np.ones(len(cell), np.bool_)
        head[1:] = ordered[1:] != ordered[:-1]
        back = np.empty(len(cell), np.int64)
        back[order] = np.cumsum(head) - 1
        return ordered[head] << U64(64 - self.bits), back

    def ask(self, chunk: int, keys: np.ndarray, counts: np.ndarray) -> list[dict]:
        """Questions for distinct keys and how often the chunk has each."""
        out = []
        for row in range(self.depth):
            cells, back = self._cells(row, keys)
            sums = np.minimum(np.bincount(back, weights=counts, minlength=len(cells)), self.levels[-1]).astype(self.count)
            small = cells >> U64(64 - self.bits)
            bounds = by_bucket(cells, self.buckets)
            full = _full(bounds)
            out.append(
                {
                    "bucket": [row * self.buckets + b for b in full],
                    "chunk": [chunk] * len(full),
                    "keys": [gaps(small[bounds[b] : bounds[b + 1]]) for b in full],
                    "rest": [planes(sums[bounds[b] : bounds[b + 1]]) for b in full],
                }
            )
        return out

    def merge(self, rows: pa.Table) -> pa.Table:
        """Adds up one bucket's cells over all chunks."""
        cells = [ungaps(raw) for raw in rows.column("keys").to_pylist()]
        ends = np.cumsum([len(c) for c in cells])[:-1]
        counts = np.concatenate([unplanes(raw, self.count) for raw in rows.column("rest").to_pylist()])
        every = np.concatenate(cells)
        order = np.argsort(every)
        ordered = every[order]
        head = np.ones(len(every), np.bool_)
        head[1:] = ordered[1:] != ordered[:-1]
        group = np.empty(len(every), np.int64)
        group[order] = np.cumsum(head) - 1
        total = np.bincount(group, weights=counts)[group]
        by_level = [np.split(total >= level, ends) for level in self.levels]
        return answered(rows, [np.concatenate(own) for own in zip(*by_level)])

    def reached(self, rows: pa.Table, keys: np.ndarray) -> list[np.ndarray]:
        """For each level, which keys are estimated to occur at least so often in the corpus."""
        found = [np.ones(len(keys), np.bool_) for _ in self.levels]
        for row in range(self.depth):
            cells, back = self._cells(row, keys)
            bounds = by_bucket(cells, self.buckets)
            reach = np.zeros((len(self.levels), len(cells)), np.bool_)
            for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist()):
                b = bucket - row * self.buckets
                if 0 <= b < self.buckets:
                    n = bounds[b + 1] - bounds[b]
                    own = np.unpackbits(np.frombuffer(bits, np.uint8), count=n * len(self.levels))
                    reach[:, bounds[b] : bounds[b + 1]] = own.reshape(len(self.levels), n)
            for level, own in zip(reach, found):
                own &= level[back]
        return found
