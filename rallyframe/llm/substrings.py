"""Removal of word windows that an earlier document has: a count-min prefilter, then exact groups."""

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

#: Bytes of a word with its space, for sizing; keys that a bucket holds, about.
WORD_BYTES, BUCKET_KEYS = 6, 1 << 20
RESULTS = ["doc_id", "n_words", "n_removed", "kept_text"]
#: A missing id is less than every other.
NO_ID = np.iinfo(np.int64).min


class Windows:
    """The windows of one chunk, grouped by fingerprint."""

    def __init__(self, rows: pa.Table, window: int):
        prints, sizes = [], []
        for _, _, data, bounds in T.slices(rows.column("text")):
            starts, ends, words = T.word_spans(data, bounds, T.NOT_SPACE)
            prints.append(T.span_prints(data, starts, ends))
            sizes.append(np.diff(words))
        self.words = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        self.n_words = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.n_words)))
        self.window = window
        ids = rows.column("doc_id").cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
        self.starts, row = T.window_starts(self.bounds, window)
        self.ids = ids[row]
        prints = T.window_prints(self.words, window)[self.starts]
        self.order = np.argsort(prints)
        ordered = prints[self.order]
        head = np.ones(len(ordered), np.bool_)
        head[1:] = ordered[1:] != ordered[:-1]
        self.head = head
        at = np.flatnonzero(head)
        self.keys = ordered[at]
        owners = self.ids[self.order]
        self.least = np.minimum.reduceat(owners, at) if len(at) else owners
        self.counts = 1 + (np.maximum.reduceat(owners, at) > self.least) if len(at) else owners
        self.sample = self.starts[self.order[at]]

    def second(self, which: np.ndarray) -> np.ndarray:
        """Another 32 bits of fingerprint of the chosen keys."""
        starts = self.sample[which]
        total = np.zeros(len(starts), np.uint64)
        for k in range(self.window):
            total = total * T.STEP + self.words[starts + k]
        return (T.mixed(total) >> np.uint64(32)).astype("<u4")


def _merge(rows: pa.Table) -> pa.Table:
    """One bucket of exact questions: which entries' documents come after the window's first one."""
    keys = [C.ungaps(raw) for raw in rows.column("keys").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    second, least = [], []
    for raw, n in zip(rows.column("rest").to_pylist(), sizes):
        least.append(C.unplanes(raw[: 8 * n], "<i8"))
        second.append(C.unplanes(raw[8 * n :], "<u4"))
    key, second, least = np.concatenate(keys), np.concatenate(second), np.concatenate(least)
    order = np.lexsort((second, key))
    k, s = key[order], second[order]
    head = np.ones(len(k), np.bool_)
    head[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    first = np.minimum.reduceat(least[order], np.flatnonzero(head))
    later = np.empty(len(k), np.bool_)
    later[order] = first[np.cumsum(head) - 1] < least[order]
    return C.answered(rows, np.split(later, np.cumsum(sizes)[:-1]))


def substring_dedup(docs: DataFrame, window: int = 13, carry: Iterable[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every document, and the carried columns.

    Words lie between ASCII white space. A word goes if a window of `window` words over it also starts in a document
    with a smaller id, as the input has it; the kept words are joined by one space.

    First every chunk of documents sends the cells of a count-min sketch that its windows hit; merged, they tell it
    which windows may occur in more than one document. Of those alone it then sends exact fingerprints (96 bits) with
    its least document id, and learns for which of them another chunk has a smaller one. An estimate is never too low,
    so no repeat is lost, and whatever it lets through beyond is told apart by the exact groups.

    Null text has no words; a null id is smaller than any other; rows that share an id do not remove each other's
    words; equal rows stay. Documents shorter than the window are kept whole. An empty table gives an empty result.
    """
    source = documents(docs, carry, RESULTS)
    source = source.withColumn("doc_id", F.col("doc_id").cast("long"))
    _, total = text_bytes(source)
    n_keys = total // WORD_BYTES
    buckets = max(1, -(-n_keys // BUCKET_KEYS))
    sketch = C.Sketch(n_keys, buckets)
    exact = sketch.depth * buckets  # the first bucket of exact questions
    notes = exact + buckets  # from here on: what a chunk tells itself
    placed = C.dealt(source, C.n_chunks(total))
    by_chunk = placed.groupBy("chunk")

    def ask(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = Windows(rows, window)
        return C.asked(*sketch.ask(key[0].as_py(), found.keys, found.counts))

    def add(rows: pa.Table) -> pa.Table:
        return sketch.merge(rows)

    def ask_exactly(key: tuple[pa.Scalar, ...], rows: pa.Table, said: pa.Table) -> pa.Table:
        found, chunk = Windows(rows, window), key[0].as_py()
        (maybe,) = sketch.reached(said, found.keys)
        keys, least, second = found.keys[maybe], found.least[maybe].astype("<i8"), found.second(maybe)
        note = {"bucket": [notes + chunk], "chunk": [chunk], "keys": [b""], "rest": [np.packbits(maybe).tobytes()]}
        rest = lambda a, b: C.planes(least[a:b]) + C.planes(second[a:b])
        return C.asked(C.questions(chunk, buckets, keys, rest, exact), note)

    def group(rows: pa.Table) -> pa.Table:
        if rows.column("bucket")[0].as_py() >= notes:
            return rows.select(["chunk", "bucket", "rest"]).rename_columns(["chunk", "bucket", "bits"])
        return _merge(rows)

    def keep(key: tuple[pa.Scalar, ...], rows: pa.Table, said: pa.Table) -> pa.Table:
        found, note = Windows(rows, window), notes + key[0].as_py()
        own = said.filter(pc.equal(said.column("bucket"), note)).column("bits")[0].as_py()
        maybe = np.unpackbits(np.frombuffer(own, np.uint8), count=len(found.keys)).astype(np.bool_)
        later = np.zeros(len(found.keys), np.bool_)
        later[maybe] = C.answers(said, exact, buckets, found.keys[maybe])
        group = np.cumsum(found.head) - 1
        gone = later[group] | (found.ids[found.order] > found.least[group])
        hit = T.covered(found.starts[found.order[gone]], window, len(found.words))
        removed = np.diff(np.concatenate(([0], np.cumsum(hit)))[found.bounds])
        texts, bounds = [], found.bounds.tolist()
        for k, text in enumerate(rows.column("text").to_pylist()):
            words = (text or b"").split()
            if removed[k]:
                own = hit[bounds[k] : bounds[k + 1]].tolist()
                words = [word for word, out in zip(words, own) if not out]
            texts.append(b" ".join(words))
        columns = {
            "doc_id": rows.column("doc_id"),
            "n_words": pa.array(found.n_words, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(texts, pa.binary()),
        }
        if "carried" in rows.column_names:
            columns["carried"] = rows.column("carried")
        return pa.table(columns)

    likely = by_chunk.applyInArrow(ask, C.ASKED).groupBy("bucket").applyInArrow(add, C.ANSWERED)
    wanted = by_chunk.cogroup(likely.groupBy("chunk")).applyInArrow(ask_exactly, C.ASKED)
    told = wanted.groupBy("bucket").applyInArrow(group, C.ANSWERED)
    rows = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(
        keep, result_schema(source, "n_words long, n_removed long, kept_text binary")
    )
    return unpacked(rows.withColumn("kept_text", F.col("kept_text").cast("string")))
