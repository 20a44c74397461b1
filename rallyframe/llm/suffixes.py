"""Removal of repeated byte strings: longest-previous-factor arrays over the suffixes that may repeat."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm import chunks as C
from rallyframe.llm import textbytes as T
from rallyframe.llm.inputs import documents, result_schema, text_bytes, unpacked

#: Anchors of a bucket of the sketch and of a bucket of segments, about.
SKETCH_KEYS, BUCKET_KEYS = 1 << 18, 1 << 15
#: Anchors with so many segments are asked about window by window.
HOT_ANCHOR = 1 << 14
#: Bytes of segments that one suffix order covers, unless one anchor alone has more.
ORDER_BYTES = 1 << 18
RESULTS = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
NO_ID = np.iinfo(np.int64).min


def gram_size(length: int) -> int:
    """Bytes of the grams whose least fingerprint anchors a window: about half of it, in whole lanes."""
    return max(8, length // 16 * 8)


def anchored_runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, end start) of the runs of windows that share the place of their least gram.

    A window's anchor is the fingerprint of its least gram, the leftmost among equals. Both depend on the window's bytes
    alone, so equal windows have equal anchors in equal places, and two equal windows never share a run.
    """
    gram = gram_size(length)
    n = len(data) - length + 1
    sizes = np.maximum(np.diff(bounds) - length + 1, 0)
    if n <= 0 or not sizes.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    eight = T.mixed(T.lanes(data)[: len(data) - 7])
    grams = eight[: len(data) - gram + 1].copy()
    for k in range(8, gram, 8):
        grams *= T.LANE
        grams += eight[k : k + len(grams)]
    grams = T.mixed(grams)
    low = np.uint64(0xFFFFFFFF)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    least &= low
    valid = np.zeros(n + 1, np.bool_)
    valid[T.ragged(bounds[:-1], sizes)] = True
    head = valid[:n].copy()
    head[1:] &= ~valid[: n - 1] | (least[1:n] != least[: n - 1])
    first = np.flatnonzero(head)
    tail = valid[:n] & (~valid[1:] | np.append(head[1:], True))
    return grams[least[first].astype(np.int64)], first, np.flatnonzero(tail) + 1


def previous_factors(place: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factors in suffix order, as far as they are at least `least` long (else something shorter).

    `place` is each suffix's place in the text, `common` its common prefix with the suffix before it in the order. The
    nearest suffixes on either side with a smaller place are found by pointer jumping; the longer of the two common
    prefixes is the factor.
    """
    n = len(place)
    best = np.zeros(n, np.int64)
    for forward in (True, False):
        p = place if forward else place[::-1]
        shared = np.zeros(n, np.int64)  # with the neighbour that lies before, seen in this direction
        shared[1:] = common[1:] if forward else common[::-1][:-1]
        at = np.arange(n) - 1
        shared[0] = 0
        live = np.flatnonzero((at >= 0) & (shared >= least))
        while len(live := live[p[at[live]] >= p[live]]):
            shared[live] = np.minimum(shared[live], shared[at[live]])
            at[live] = at[at[live]]
            out = live[(at[live] < 0) | (shared[live] < least)]
            shared[out[at[out] < 0]] = 0
            live = live[(at[live] >= 0) & (shared[live] >= least)]
        best = np.maximum(best, shared if forward else shared[::-1])
    return best


def repeated_windows(data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, lows: np.ndarray, length: int) -> np.ndarray:
    """For every window of the segments, one after the other: whether it also starts at an earlier place.

    A segment is a stretch of text at (`ids`, `lows`). Suffixes are ordered by their first `length` bytes, by doubling.
    """
    counts = np.diff(bounds) - length + 1
    starts = T.ragged(bounds[:-1], counts)
    segment = np.repeat(np.arange(len(counts)), counts)
    at = starts - bounds[:-1][segment] + lows[segment]
    order = np.lexsort((at, ids[segment]))
    place = np.empty(len(starts), np.int64)
    a, b = ids[segment][order], at[order]
    place[order] = np.cumsum(np.concatenate(([0], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    rank = T.lanes(data)[: len(data)].byteswap()
    have = 8
    levels = []
    while True:
        _, rank = np.unique(rank, return_inverse=True)
        levels.append((have, rank))
        step = min(have, length - have)
        if not step:
            break
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - step] = rank[step:]
        rank = (rank.astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        have += step
    own = rank[starts][order]
    by = np.argsort(own, kind="stable")  # places in order among equals
    suffix = order[by]
    # the common prefix of neighbours, from the ranks of the doubling: exact at `length`, else in whole steps
    common = np.zeros(len(suffix), np.int64)
    left, right = starts[suffix[:-1]], starts[suffix[1:]]
    equal = rank[left] == rank[right]
    for size, ranks in levels[-2::-1]:
        more = ~equal & (common[1:] + size <= length)
        k = np.flatnonzero(more)
        same = ranks[left[k] + common[1:][k]] == ranks[right[k] + common[1:][k]]
        common[1:][k[same]] += size
    common[1:][equal] = length
    common[1:][~equal] = np.minimum(common[1:][~equal], length - 1)
    found = np.empty(len(starts), np.bool_)
    found[suffix] = previous_factors(place[suffix], common, length) >= length
    return found


class Segments:
    """The windows of one chunk that may repeat: stretches of text, each distinct one once with its first place."""

    def __init__(self, rows: pa.Table, length: int):
        self.length = length
        parts, runs, bounds, at = [], [], [np.zeros(1, np.int64)], 0
        for _, _, data, own in T.slices(rows.column("text")):
            anchor, first, end = anchored_runs(data, own, length)
            runs.append((anchor, first + at, end + at))
            parts.append(data)
            bounds.append(own[1:] + at)
            at += len(data)
        self.data = np.concatenate(parts) if parts else np.empty(0, np.uint8)
        self.bounds = np.concatenate(bounds)
        self.anchor, self.first, self.end = (
            [np.concatenate(x) for x in zip(*runs)]
            if runs
            else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        )
        ids = rows.column("doc_id").cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
        self.ids = ids

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct anchors, runs of each, the anchor of each run)."""
        keys, back = np.unique(self.anchor, return_inverse=True)
        return keys, np.bincount(back, minlength=len(keys)), back

    def take(self, maybe: np.ndarray, hot: np.ndarray) -> None:
        """Keep the runs marked `maybe`; of those marked `hot`, every window becomes a segment of its own."""
        whole, split = maybe & ~hot, maybe & hot
        singles = T.ragged(self.first[split], (self.end - self.first)[split])
        first = np.concatenate((self.first[whole], singles))
        size = np.concatenate(((self.end - self.first)[whole], np.ones(len(singles), np.int64))) + self.length - 1
        a = T.span_prints(self.data, first, first + size, 1)
        b = T.span_prints(self.data, first, first + size, 2)
        key = np.concatenate((self.anchor[whole], a[len(first) - len(singles) :]))
        row = np.searchsorted(self.bounds, first, side="right") - 1
        # rows without bytes share a bound with the next; the last of them is the one that holds the place
        doc, low = self.ids[row], first - self.bounds[row]
        order = np.lexsort((low, doc, b, a, key))
        head = np.ones(len(order), np.bool_)
        x = order[1:], order[:-1]
        head[1:] = (key[x[0]] != key[x[1]]) | (a[x[0]] != a[x[1]]) | (b[x[0]] != b[x[1]])
        lead = order[head]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(head) - 1
        self.starts, self.sizes, self.entry = first, size, entry
        self.key, self.doc, self.low = key[lead], doc[lead], low[lead]
        self.at, self.size = first[lead], size[lead]
        # occurrences after the chunk's first one are removed whatever other chunks have
        self.later = (doc > self.doc[entry]) | ((doc == self.doc[entry]) & (low > self.low[entry]))

    def rest(self, a: int, b: int) -> bytes:
        """What goes with entries a to b: places, sizes and the bytes themselves."""
        text = self.data[T.ragged(self.at[a:b], self.size[a:b])]
        columns = (self.doc[a:b].astype("<i8"), self.low[a:b].astype("<i8"), self.size[a:b].astype("<i8"))
        return b"".join([*map(C.planes, columns), text.tobytes()])

    def removed(self, said: pa.Table, first: int, buckets: int) -> np.ndarray:
        """Which bytes of the chunk go, from the answers of buckets `first` and on."""
        windows = self.size - self.length + 1
        ends = np.concatenate(([0], np.cumsum(windows)))
        bits = np.zeros(ends[-1], np.bool_)
        bounds = C.by_bucket(self.key, buckets)
        for bucket, raw in zip(said.column("bucket").to_pylist(), said.column("bits").to_pylist()):
            if first <= bucket < first + buckets:
                a, b = ends[bounds[bucket - first]], ends[bounds[bucket - first + 1]]
                bits[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a)
        counts = self.sizes - self.length + 1
        starts = T.ragged(self.starts, counts)
        gone = np.repeat(self.later, counts) | bits[T.ragged(ends[self.entry], counts)]
        return T.covered(starts[gone], self.length, len(self.data))


def merge_segments(rows: pa.Table, length: int) -> pa.Table:
    """One bucket: every window of every entry, whether an earlier place has it."""
    keys, columns, texts = [], [], []
    for raw, rest in zip(rows.column("keys").to_pylist(), rows.column("rest").to_pylist()):
        keys.append(C.ungaps(raw))
        n = len(keys[-1])
        columns.append([C.unplanes(rest[8 * n * k : 8 * n * (k + 1)], "<i8") for k in range(3)])
        texts.append(rest[24 * n :])
    owner = np.cumsum([len(k) for k in keys])[:-1]
    key = np.concatenate(keys)
    doc, low, size = (np.concatenate(x) for x in zip(*columns))
    data = np.frombuffer(b"".join(texts), np.uint8)
    del texts, columns, keys
    begin = np.cumsum(size) - size
    a, b = (T.span_prints(data, begin, begin + size, seed) for seed in (1, 2))
    order = np.lexsort((low, doc, b, a, key))
    prev, this = order[:-1], order[1:]
    new_key = np.concatenate(([True], key[this] != key[prev]))
    head = new_key | np.concatenate(([True], (a[this] != a[prev]) | (b[this] != b[prev])))
    group = np.cumsum(head) - 1
    lead = order[head]  # the first place of each distinct segment
    windows = size - length + 1
    ends = np.concatenate(([0], np.cumsum(windows)))
    bits = np.zeros(ends[-1], np.bool_)
    first = lead[group]
    later = (doc[order] > doc[first]) | ((doc[order] == doc[first]) & (low[order] > low[first]))
    late = order[later]
    bits[T.ragged(ends[late], windows[late])] = True
    # distinct segments of one anchor are compared by suffix order
    family = np.cumsum(new_key[head]) - 1
    chosen = np.flatnonzero(np.bincount(family)[family] > 1)
    cut = np.cumsum(size[lead[chosen]])
    edge = 0
    while edge < len(chosen):
        done = cut[edge - 1] if edge else 0
        upto = int(np.searchsorted(cut, done + ORDER_BYTES, side="right"))
        upto = max(upto, edge + 1)
        # families stay together
        upto = int(np.searchsorted(family[chosen], family[chosen[upto - 1]], side="right"))
        own = lead[chosen[edge:upto]]
        part = data[T.ragged(begin[own], size[own])]
        found = repeated_windows(part, np.concatenate(([0], np.cumsum(size[own]))), doc[own], low[own], length)
        bits[T.ragged(ends[own], windows[own])] = found
        edge = upto
    # segments at the first place of their kind, in several rows of one id, share what that place has
    same = order[~later & ~head]
    if len(same):
        of = first[~later & ~head]
        bits[T.ragged(ends[same], windows[same])] = bits[T.ragged(ends[of], windows[of])]
    bounds = [0, *ends[owner].tolist(), int(ends[-1])]
    return C.answered(rows, [bits[x:y] for x, y in zip(bounds[:-1], bounds[1:])])


def suffix_dedup(docs: DataFrame, length: int = 100, carry: Iterable[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end) and kept of every document's UTF-8 bytes.

    A byte goes if a string of `length` bytes over it also starts earlier: in a document with a smaller id, or in the
    same one further ahead; overlaps count, and the input decides, not what is left of it.

    A window of `length` bytes is anchored by its least gram fingerprint. A count-min sketch of the anchors tells each
    chunk which may occur more than once; for those it sends the stretch of text that its windows span to the anchor's
    bucket, equal stretches once. A bucket orders the suffixes of the distinct stretches of each anchor and finds the
    longest previous factor of each from the nearest smaller places before and after it in that order: where it
    reaches `length`, the window goes. An anchor that very many stretches share is asked about window by window, so
    that its windows spread over all buckets.

    Null text is empty; a null id is smaller than any other; rows that share an id count as the same document. Texts
    shorter than `length` are kept whole. An empty table gives an empty result.
    """
    source = documents(docs, carry, RESULTS)
    source = source.withColumn("doc_id", F.col("doc_id").cast("long"))
    _, total = text_bytes(source)
    n_keys = 2 * total // (length - gram_size(length) + 2)
    buckets = max(1, -(-n_keys // BUCKET_KEYS))
    sketch = C.Sketch(n_keys, max(1, -(-n_keys // SKETCH_KEYS)), levels=(2, HOT_ANCHOR))
    exact = sketch.depth * sketch.buckets
    notes = exact + buckets
    placed = C.dealt(source, C.n_chunks(total))
    by_chunk = placed.groupBy("chunk")

    def ask(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys, counts, _ = Segments(rows, length).keys()
        return C.asked(*sketch.ask(key[0].as_py(), keys, counts))

    def add(rows: pa.Table) -> pa.Table:
        return sketch.merge(rows)

    def ask_exactly(key: tuple[pa.Scalar, ...], rows: pa.Table, said: pa.Table) -> pa.Table:
        found, chunk = Segments(rows, length), key[0].as_py()
        keys, _, back = found.keys()
        maybe, hot = sketch.reached(said, keys)
        found.take(maybe[back], hot[back])
        note = np.packbits(np.concatenate((maybe, hot))).tobytes()
        own = {"bucket": [notes + chunk], "chunk": [chunk], "keys": [b""], "rest": [note]}
        return C.asked(C.questions(chunk, buckets, found.key, found.rest, exact), own)

    def group(rows: pa.Table) -> pa.Table:
        if rows.column("bucket")[0].as_py() >= notes:
            return rows.select(["chunk", "bucket", "rest"]).rename_columns(["chunk", "bucket", "bits"])
        return merge_segments(rows, length)

    def keep(key: tuple[pa.Scalar, ...], rows: pa.Table, said: pa.Table) -> pa.Table:
        found, note = Segments(rows, length), notes + key[0].as_py()
        keys, _, back = found.keys()
        own = said.filter(pc.equal(said.column("bucket"), note)).column("bits")[0].as_py()
        maybe, hot = np.unpackbits(np.frombuffer(own, np.uint8), count=2 * len(keys)).astype(np.bool_).reshape(2, -1)
        found.take(maybe[back], hot[back])
        gone = found.removed(said, exact, buckets)
        bounds = found.bounds
        before = np.concatenate(([0], np.cumsum(gone)))
        removed = np.diff(before[bounds])
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = bounds[:-1][bounds[:-1] < len(gone)]
        edge[inner] = gone[inner]
        stop = gone.copy()
        stop[:-1] &= ~gone[1:]
        last = bounds[1:][bounds[1:] > 0] - 1
        stop[last] = gone[last]
        first, end = np.flatnonzero(edge), np.flatnonzero(stop) + 1
        row = np.searchsorted(bounds, first, side="right") - 1
        n_spans = np.bincount(row, minlength=len(bounds) - 1)
        spans = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(n_spans))), pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(first - bounds[row], pa.int64()), pa.array(end - bounds[row], pa.int64())], ["start", "end"]
            ),
        )
        kept = found.data[~gone]
        kept_bounds = (bounds - before[bounds]).astype(np.int32)
        columns = {
            "doc_id": rows.column("doc_id"),
            "n_bytes": pa.array(np.diff(bounds), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "spans": spans,
            "kept": pa.BinaryArray.from_buffers(
                pa.binary(), len(kept_bounds) - 1, [None, pa.py_buffer(kept_bounds.tobytes()), pa.py_buffer(kept.tobytes())]
            ),
        }
        if "carried" in rows.column_names:
            columns["carried"] = rows.column("carried")
        return pa.table(columns)

    likely = by_chunk.applyInArrow(ask, C.ASKED).groupBy("bucket").applyInArrow(add, C.ANSWERED)
    wanted = by_chunk.cogroup(likely.groupBy("chunk")).applyInArrow(ask_exactly, C.ASKED)
    told = wanted.groupBy("bucket").applyInArrow(group, C.ANSWERED)
    rows = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(
        keep,
        result_schema(
            source,
            "n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary",
        ),
    )
    return unpacked(rows)
