"""Cross-entropy difference: two matched bigram models over one vocabulary score documents they have not seen."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rallyframe.llm import chunks as C
from rallyframe.llm import textbytes as T
from rallyframe.llm.inputs import documents, result_schema, text_bytes, unpacked
from rallyframe.llm.wordbpe import encoded, loaded

#: Weight of the single-token model in tokens seen after a context, and what every token of the vocabulary has extra.
STRENGTH, EXTRA = 20.0, 0.5
#: Distinct n-grams that a megabyte of text sends, and that a bucket holds, about.
MEGABYTE_KEYS, BUCKET_KEYS = 80_000, 1 << 20
RESULTS = ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"]


def _heads(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new combination starts in columns that are sorted by it."""
    new = np.zeros(len(sorted_by[0]), np.bool_)
    new[:1] = True
    for column in sorted_by:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _narrow(size: int) -> np.dtype:
    """The type that token ids below `size`, and `size` itself, are kept in."""
    return np.dtype("<u2" if size < 1 << 16 else "<i4")


def _tokens(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for `mapInArrow` that gives `ids` for the column `text`."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow = _narrow(loaded(path).library.get_vocab_size())
        for batch in batches:
            parts, ends = [b""], [np.zeros(1, np.int64)]
            for _, _, ids, bounds in encoded(batch.column("text"), path):
                parts.append(ids.astype(narrow).tobytes())
                ends.append(ends[-1][-1] + bounds[1:] * narrow.itemsize)
            places = pa.py_buffer(np.concatenate(ends).astype(np.int32))
            ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, places, pa.py_buffer(b"".join(parts))])
            others = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in others), ids], names=[*others, "ids"])

    return encode


class Grams:
    """The distinct tokens and pairs of one chunk as numbers, and how often each of its documents has them.

    With `size` tokens, `size` itself is the mark before and after each text. A number below size + 1 is a token, the
    next size + 1 squared ones are pairs, and the last one stands for all tokens.
    """

    def __init__(self, rows: pa.Table, path: str):
        size = loaded(path).library.get_vocab_size()
        narrow = _narrow(size)
        parts, counts = [np.empty(0, narrow)], [np.empty(0, np.int64)]
        for column in rows.column("ids").chunks:
            raw = column.cast(pa.large_binary())
            bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            n = np.diff(bounds) // narrow.itemsize + 1
            inner = np.ones(int(n.sum()), np.bool_)
            inner[np.cumsum(n) - 1] = False
            out = np.full(len(inner), size, narrow)
            if bounds[-1] > bounds[0]:
                out[inner] = np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(narrow)
            parts.append(out)
            counts.append(n)
        self.base = size + 1
        self.every = self.base + self.base * self.base
        #: predicted tokens of each document: its own and the end
        self.n = np.concatenate(counts)
        token = np.concatenate(parts)
        # the mark before a text is the end of the one before it
        context = np.roll(token, 1)
        document = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        # sorts that keep the order of equals: by token and document, then by context, token and document
        order = np.argsort(token, kind="stable")
        ordered, owner = token[order], document[order]
        at = _heads(ordered, owner)
        self.token, self.token_doc, self.token_n = ordered[at], owner[at], np.diff(at, append=len(token))
        own = np.empty(len(token), np.int32)
        own[order] = np.repeat(self.token_n, self.token_n)
        order = order[np.argsort(context[order], kind="stable")]
        before, ordered, owner = context[order], token[order], document[order]
        at = _heads(before, ordered, owner)
        first = order[at]
        #: for each pair of a document: its context and token, how often the document has the pair and each of these
        self.before, self.after, self.pair_doc = before[at], ordered[at], owner[at]
        self.pair_n, self.after_n, self.before_n = np.diff(at, append=len(token)), own[first], own[first - 1]
        head = _heads(self.before, self.after)
        self.pair_of = np.repeat(np.arange(len(head)), np.diff(head, append=len(at)))
        self.pairs = self.base + self.before[head].astype(np.int64) * self.base + self.after[head]

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often the documents marked in `chosen` have each of `numbers()`; the total comes last."""
        single = np.bincount(self.token, weights=self.token_n * chosen[self.token_doc], minlength=self.base)
        pair = np.bincount(self.pair_of, weights=self.pair_n * chosen[self.pair_doc], minlength=len(self.pairs))
        return np.concatenate((single, pair, [self.n[chosen].sum()])).astype(np.int64)

    def numbers(self) -> np.ndarray:
        return np.concatenate((np.arange(self.base), self.pairs, [self.every])).astype(np.uint64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted 64-bit keys of the numbers that occur, the place of each in `numbers()`).

        A key is a hash that no two numbers share, so common tokens are dealt evenly over ranges of keys.
        """
        tokens = np.flatnonzero(np.bincount(self.token, minlength=self.base))
        seen = np.concatenate((tokens, np.arange(self.base, self.base + len(self.pairs) + 1)))
        keys = T.mixed(self.numbers()[seen])
        order = np.argsort(keys)
        return keys[order], seen[order]

    def losses(
        self, counts: np.ndarray, copies: np.ndarray, weight: float, strength: float, extra: float
    ) -> np.ndarray:
        """The mean loss of each document, from the counts of `numbers()` in a set of documents.

        A document's own counts are taken off as often as the set has its text (`copies`); the rest counts `weight`.
        """
        times = copies[self.pair_doc]
        single, pair = counts[: self.base], counts[self.base : -1]
        total = weight * np.maximum(counts[-1] - copies * self.n, 0) + extra * self.base
        one = (weight * np.maximum(single[self.after] - times * self.after_n, 0) + extra) / total[self.pair_doc]
        both = weight * np.maximum(pair[self.pair_of] - times * self.pair_n, 0)
        # a token is a context as often as it is predicted; the mark before a text as often as the one after it
        context = weight * np.maximum(single[self.before] - times * self.before_n, 0)
        loss = -np.log((both + strength * one) / (context + strength))
        return np.bincount(self.pair_doc, weights=loss * self.pair_n, minlength=len(self.n)) / self.n


def same_texts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of texts, which of them each document has)."""
    return np.unique(rows.column("same").to_numpy().view(np.uint64), return_inverse=True)


def cross_entropy_difference(
    docs: DataFrame,
    target_ids: DataFrame,
    tokenizer: str,
    strength: float = STRENGTH,
    extra: float = EXTRA,
    carry: Iterable[str] = (),
) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and difference (target less background) of every document.

    The losses are means over the tokens of a document and its end, in nats. The target model counts the documents
    whose id is in `target_ids` (column doc_id), the background model all others. Both are bigram models with the
    tokenizer's vocabulary and the same smoothing: a pair's share after its context, with `strength` tokens of the
    single-token model added, and `extra` counts for each token in that. So that the smoothing weighs the same in
    both, the counts of the larger set are scaled down to the size of the smaller one. No document is scored by what
    it is itself part of: its counts, and those of all documents with the same text, are taken off first. A low
    difference means close to the target.

    Every text is encoded once; counting and scoring share one exchange of its ids. Each chunk sends how often it has each distinct token, pair
    and text (as a 64-bit hash); buckets add the counts up over the corpus and send every chunk the sums of what it
    asked for.

    Null and empty texts have an end alone. Texts of any length are scored whole. Rows that share an id are all in the
    target, or none; null ids never are. Repeated ids in `target_ids` count once. Without a target, or with nothing
    else, both models are the same for all tokens and the difference is 0. Carried columns with the name of a result
    are left out. An empty table gives an empty result.
    """
    source = documents(docs, carry, RESULTS)
    source = source.withColumn("doc_id", F.col("doc_id").cast("long"))
    n_rows, total = text_bytes(source)
    chunks = C.n_chunks(total)
    buckets = max(1, -(-(total * MEGABYTE_KEYS // (1 << 20)) // BUCKET_KEYS))
    text_buckets = max(1, -(-n_rows // BUCKET_KEYS))
    chunk = C.chunk_of(chunks, "doc_id")
    same = F.xxhash64(F.coalesce("text", F.lit("").cast("binary"))).alias("same")
    texts = source.select(chunk, same, *source.columns)
    tokens = StructType([field for field in texts.schema.fields if field.name != "text"]).add("ids", "binary")
    placed = texts.mapInArrow(_tokens(tokenizer), tokens).repartition("chunk")
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    targets = wanted.select(chunk, "doc_id")

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table, chosen: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return C.asked()
        grams = Grams(rows, tokenizer)
        mine = pc.is_in(rows.column("doc_id"), value_set=chosen.column("doc_id").combine_chunks())
        mine = mine.to_numpy(zero_copy_only=False).astype(np.bool_)
        keys, at = grams.keys()
        texts, back = same_texts(rows)
        asks = []
        for keys, every, target, n, first in (
            (keys, grams.counts(np.ones(len(mine), np.bool_))[at], grams.counts(mine)[at], buckets, 0),
            (texts, np.bincount(back), np.bincount(back, weights=mine), text_buckets, buckets),
        ):
            both = every.astype("<u8"), target.astype("<u8")
            rest = lambda a, b, both=both: b"".join(C.planes(x[a:b]) for x in both)
            asks.append(C.questions(key[0].as_py(), n, keys, rest, first))
        return C.asked(*asks)

    def add(rows: pa.Table) -> pa.Table:
        keys = [C.ungaps(raw) for raw in rows.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        raw = [(x[: len(x) // 2], x[len(x) // 2 :]) for x in rows.column("rest").to_pylist()]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for half in range(2):
            own = np.concatenate([C.unplanes(x[half], "<u8") for x in raw]).astype(np.int64)
            sums.append(np.bincount(back, weights=own, minlength=len(distinct)).astype("<u8")[back])
        said = [C.planes(a) + C.planes(b) for a, b in zip(*(np.split(x, ends) for x in sums))]
        names = {"chunk": rows.column("chunk"), "bucket": rows.column("bucket")}
        return pa.table(names | {"bits": pa.array(said, pa.binary())})

    def score(key: tuple[pa.Scalar, ...], rows: pa.Table, said: pa.Table) -> pa.Table:
        grams = Grams(rows, tokenizer)
        keys, at = grams.keys()
        texts, back = same_texts(rows)
        bounds, text_bounds = C.by_bucket(keys, buckets), C.by_bucket(texts, text_buckets)
        sums, copies = np.zeros((2, grams.base + len(grams.pairs) + 1)), np.zeros((2, len(texts)))
        for bucket, raw in zip(said.column("bucket").to_pylist(), said.column("bits").to_pylist()):
            both = [C.unplanes(x, "<u8") for x in (raw[: len(raw) // 2], raw[len(raw) // 2 :])]
            if bucket < buckets:
                sums[:, at[bounds[bucket] : bounds[bucket + 1]]] = both
            else:
                copies[:, text_bounds[bucket - buckets] : text_bounds[bucket - buckets + 1]] = both
        # what is not in the target is the background
        sums[0] -= sums[1]
        copies[0] -= copies[1]
        size = sums[:, -1].min()
        background, target = (
            grams.losses(x, y[back], size / max(x[-1], 1.0), strength, extra) for x, y in zip(sums, copies)
        )
        columns = {
            "doc_id": rows.column("doc_id"),
            "n_tokens": pa.array(grams.n - 1, pa.int64()),
            "target_loss": pa.array(target),
            "background_loss": pa.array(background),
        }
        if "carried" in rows.column_names:
            columns["carried"] = rows.column("carried")
        return pa.table(columns)

    asked = placed.groupBy("chunk").cogroup(targets.groupBy("chunk")).applyInArrow(count, C.ASKED)
    told = asked.groupBy("bucket").applyInArrow(add, C.ANSWERED)
    kept = ["carried"] if "carried" in source.columns else []
    rows = (
        placed.groupBy("chunk")
        .cogroup(told.groupBy("chunk"))
        .applyInArrow(score, result_schema(source, "n_tokens long, target_loss double, background_loss double"))
    )
    scored = rows.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
    return unpacked(scored.select(*RESULTS, *kept))
