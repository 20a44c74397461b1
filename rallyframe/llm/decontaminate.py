"""Benchmark passages in training text, found by an FM-index of every shard."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rallyframe.llm import textbytes as T
from rallyframe.llm.fmindex import FMIndex
from rallyframe.llm.inputs import documents, unpacked
from rallyframe.session import settle

#: Bytes of benchmark text whose phrases one pass over the documents looks for, about.
PASS_BYTES = 8 << 20
#: Bytes of text in a shard that gets an index, about.
SHARD_BYTES = 1 << 20
RESULTS = ["doc_id", "n_words", "n_hit", "items", "spans", "cleaned"]


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, starts, ends, bounds of the rows in words): runs of letters, digits and bytes beyond ASCII."""
    lowered = T.LOWER[data]
    starts, ends, rows = T.word_spans(lowered, bounds, T.ALNUM)
    return T.span_prints(lowered, starts, ends), starts, ends, rows


class Phrases:
    """The distinct windows of benchmark items as rows of word numbers, by length, and the items that have each."""

    def __init__(self, items: list[str], texts: list[bytes], window: int):
        prints, _, _, rows = words_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        self.vocabulary, number = np.unique(prints, return_inverse=True)
        number = number + 2  # 0 ends a text, 1 parts its runs
        self.names = sorted(set(items))
        place = {name: k for k, name in enumerate(self.names)}
        owners = np.array([place[name] for name in items], np.int64)
        sizes = np.diff(rows)
        length = np.minimum(sizes, window)
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in sorted(set(length[length > 0].tolist())):
            chosen = np.flatnonzero(length == size)
            counts = sizes[chosen] - size + 1
            starts = T.ragged(rows[:-1][chosen], counts)
            table = number[starts[:, None] + np.arange(size)]
            phrases, back = np.unique(table, axis=0, return_inverse=True)
            pairs = np.unique(np.stack((back.reshape(-1), np.repeat(owners[chosen], counts))), axis=1)
            self.tables.append((size, phrases, np.searchsorted(pairs[0], np.arange(len(phrases) + 1)), pairs[1]))
        self.shortest = self.tables[0][0] if self.tables else 0
        self.size = len(self.vocabulary) + 2
        self.maybe = np.zeros(1 << 16, np.bool_)
        self.maybe[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def numbers(self, prints: np.ndarray) -> np.ndarray:
        """The number of each word; 0 for words that no phrase has."""
        out = np.zeros(len(prints), np.int64)
        maybe = np.flatnonzero(self.maybe[(prints >> np.uint64(48)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.vocabulary, prints[maybe]), len(self.vocabulary) - 1)
        found = self.vocabulary[spot] == prints[maybe]
        out[maybe[found]] = spot[found] + 2
        return out

    def occurrences(self, prints: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, table, phrase) of every occurrence in a shard whose rows are bounded by `rows`.

        Words that no phrase has part the text, and runs of fewer words than the shortest phrase cannot hold one; the
        index covers the rest.
        """
        nothing = (np.empty(0, np.int64),) * 4
        if not self.tables:
            return nothing
        number = self.numbers(prints)
        inside = number > 0
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        row_heads = rows[:-1][rows[:-1] < len(prints)]
        head[row_heads] = inside[row_heads]
        first = np.flatnonzero(head)
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | head[1:]
        size = np.flatnonzero(stop) + 1 - first
        long = size >= self.shortest
        first, size = first[long], size[long]
        if not len(first):
            return nothing
        # each run and a separator after it
        where = T.ragged(first, size + 1)
        parts = np.cumsum(size + 1) - 1
        text = number[np.minimum(where, len(number) - 1)]
        text[parts] = 1
        index = FMIndex(text, self.size)
        out = []
        for table, (length, phrases, _, _) in enumerate(self.tables):
            low, high = index.search(phrases)
            counts = high - low
            hit = np.flatnonzero(counts)
            if len(hit):
                at = index.locate(T.ragged(low[hit], counts[hit]))
                phrase = np.repeat(hit, counts[hit])
                out.append((where[at], np.full(len(at), length), np.full(len(at), table), phrase))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else nothing

    def items_of(self, rows: np.ndarray, tables: np.ndarray, phrases: np.ndarray) -> dict[int, list[str]]:
        """The sorted names of the items that occur in each row."""
        pairs = []
        for table, (_, _, begin, owners) in enumerate(self.tables):
            row, phrase = np.unique(np.stack((rows[tables == table], phrases[tables == table])), axis=1)
            counts = begin[phrase + 1] - begin[phrase]
            pairs.append(np.stack((np.repeat(row, counts), owners[T.ragged(begin[phrase], counts)])))
        row, owner = np.unique(np.concatenate(pairs, axis=1), axis=1)
        found: dict[int, list[str]] = {}
        for r, o in zip(row.tolist(), owner.tolist()):
            found.setdefault(r, []).append(self.names[o])
        return found


def _spans(hit: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of the maximal runs of hit words within rows."""
    head = hit.copy()
    head[1:] &= ~hit[:-1]
    inner = rows[:-1][rows[:-1] < len(hit)]
    head[inner] = hit[inner]
    stop = hit.copy()
    stop[:-1] &= ~hit[1:] | head[1:]
    first = np.flatnonzero(head)
    return np.searchsorted(rows, first, side="right") - 1, first, np.flatnonzero(stop) + 1


_SPAN = "array<struct<start: long, end: long, from_byte: long, to_byte: long>>"


def _pass(source: DataFrame, phrases: Phrases) -> DataFrame:
    """The columns of `source`, n_words, spans and items; a span has its words and its bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(x, pa.int64()) for x in ("start", "end", "from_byte", "to_byte")])
        for batch in batches:
            for begin, end, data, bounds in T.slices(batch.column("text"), SHARD_BYTES):
                prints, starts, ends, rows = words_of(data, bounds)
                at, length, table, phrase = phrases.occurrences(prints, rows)
                hit = np.zeros(len(prints), np.bool_)
                for size in np.unique(length):
                    hit |= T.covered(at[length == size], int(size), len(prints))
                row, first, last = _spans(hit, rows)
                items = phrases.items_of(np.searchsorted(rows, at, side="right") - 1, table, phrase) if len(at) else {}
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(len(rows))), pa.int32()),
                    pa.StructArray.from_arrays(
                        [
                            pa.array(x, pa.int64())
                            for x in (
                                first - rows[row],
                                last - rows[row],
                                starts[first] - bounds[row],
                                ends[last - 1] - bounds[row],
                            )
                        ],
                        fields=list(kind),
                    ),
                )
                names = pa.array([items.get(k, []) for k in range(end - begin)], pa.list_(pa.string()))
                kept = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(np.diff(rows), pa.int64()), spans, names],
                    names=[*kept.schema.names, "n_words", "spans", "items"],
                )

    results = StructType.fromDDL(f"n_words long, spans {_SPAN}, items array<string>")
    return source.mapInArrow(find, StructType([*source.schema.fields, *results.fields]))


def _cleaned(rows: DataFrame) -> DataFrame:
    """`cleaned`: the text without the bytes of its spans."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if text is not None and spans:
                    edges = [0, *[x for s in spans for x in (s["from_byte"], s["to_byte"])], len(text)]
                    text = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append(text)
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, "text", pa.array(out, pa.binary()))

    return rows.mapInArrow(cut, rows.schema).withColumn("cleaned", F.col("text").cast("string"))


def _merged(parts: DataFrame) -> DataFrame:
    """The results of several passes over the same rows (`row`), one after the other in words."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))

    def merge(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], span["end"]).alias("end"),
            last["from_byte"].alias("from_byte"),
            F.greatest(last["to_byte"], span["to_byte"]).alias("to_byte"),
        )
        meets = (F.size(done) > 0) & (last["end"] >= span["start"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    grouped = parts.groupBy("row").agg(
        F.first("n_words").alias("n_words"),
        spans.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return grouped.withColumn("spans", F.aggregate("spans", F.array().cast(_SPAN), merge))


def benchmark_overlap(
    docs: DataFrame, items: DataFrame, window: int = 10, clean: bool = False, carry: Iterable[str] = ()
) -> DataFrame:
    """doc_id, n_words, n_hit, items and spans of every document; with `clean` also its text without them.

    Words are runs of letters, digits and bytes beyond ASCII, A-Z lowered. A benchmark item (item_id, text) gives its
    windows of `window` words, or its whole text if it has fewer words. Every shard of documents gets an FM-index over
    the numbers of the words that the windows use; all windows are searched backward in it at once, their occurrences
    located, and the words they cover merged into spans (in words and bytes). `items` has the ids of the items found.

    The benchmark is the query set: its windows go to every task. Its size is counted first, and more than PASS_BYTES
    of it are searched in several passes over the documents, whose spans are then merged by row.

    Null text has no words; null and empty items give no windows, a null item id is the empty string, rows that share
    an item id are one item. Equal documents each get a row. Empty tables give no rows, or no hits.
    """
    source = documents(docs, carry, RESULTS)
    asked = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.col("text").cast("binary").alias("text"),
    ).filter(F.octet_length("text") > 0)
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(total) // PASS_BYTES))

    def phrases(k: int) -> Phrases:
        rows = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()
        return Phrases([r["item"] for r in rows], [bytes(r["text"]) for r in rows], window)

    if passes == 1:
        found = _pass(source, phrases(0))
    else:
        numbered = settle(source.withColumn("row", F.monotonically_increasing_id()))
        parts = [_pass(numbered.select("row", "text"), phrases(k)).drop("text") for k in range(passes)]
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        found = numbered.join(_merged(every), "row").drop("row")
    if clean:
        found = _cleaned(found)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    extra = ["cleaned"] if clean else []
    kept = ["carried"] if "carried" in source.columns else []
    return unpacked(found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans", *extra, *kept))
