"""Token ids of a corpus as files: one wavelet matrix for each shard, with its documents' ids and lengths."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.llm.bytebpe import encoded_bytes
from rallyframe.llm.inputs import documents, ship
from rallyframe.llm.wavelet import WaveletMatrix
from rallyframe.session import settle

#: Ids at which a shard is closed; it ends with a document, so only a longer document makes a larger one.
SHARD_TOKENS = 1 << 22
#: Occurrences that are looked up at a time.
LOOKED_UP = 1 << 16


def shard_bytes(ids: np.ndarray, names: list[int | None], lengths: np.ndarray) -> bytes:
    """A shard's file content: names (64-bit, null or not), lengths, and the wavelet matrix of all ids."""
    known = np.array([name is not None for name in names], np.uint8)
    plain = np.array([name or 0 for name in names], "<i8")
    head = zlib.compress(known.tobytes() + np.diff(plain, prepend=0).tobytes() + np.asarray(lengths, "<i8").tobytes())
    return struct.pack("<QQ", len(names), len(head)) + head + WaveletMatrix.of(ids).to_bytes()


def open_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(names, where each document begins and the last one ends, the wavelet matrix)."""
    n, size = struct.unpack_from("<QQ", raw)
    head = zlib.decompress(memoryview(raw)[16 : 16 + size])
    known = np.frombuffer(head, np.uint8, n)
    plain = np.cumsum(np.frombuffer(head, "<i8", n, n))
    lengths = np.frombuffer(head, "<i8", n, 9 * n)
    names = [name if there else None for name, there in zip(plain.tolist(), known.tolist())]
    return names, np.concatenate(([0], np.cumsum(lengths))), WaveletMatrix.from_bytes(memoryview(raw)[16 + size :])


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the ids of every document, each followed by `end_id`, to new files under `path`, in the order of doc_id.

    Documents are range-partitioned by id; a task encodes its range as it streams by and closes a shard once it holds
    SHARD_TOKENS ids. A shard is one row (part, shard, n_documents, n_tokens, data) in a Parquet file of its own, so
    Spark's commit covers it and any store that Spark writes will do. Null ids come first, null and empty texts are
    `end_id` alone. Rows that share an id follow each other and may lie in several parts; a hash of the text and the
    reading position are further keys, so one id may hold any share of the rows. Very long texts are encoded in parts.
    Other columns are left out. An empty table gives files without a row.
    """
    source = documents(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    keys = ["doc_id", "by_text", "by_place"]
    ordered = (
        source.withColumn("by_text", F.xxhash64("text"))
        .withColumn("by_place", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        held = shards = part = 0

        def closed() -> pa.RecordBatch:
            data = shard_bytes(np.concatenate(parts), names, np.array(lengths))
            row = {"part": part, "shard": shards, "n_documents": len(names), "n_tokens": held, "data": data}
            return pa.RecordBatch.from_pylist([row], schema=_SHARD)

        end = np.array([end_id], np.uint16)
        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else part
            own = batch.column("doc_id").to_pylist()
            for first, _, ids, bounds in encoded_bytes(batch.column("text"), tokenizer):
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    names.append(own[first + k])
                    lengths.append(b - a + 1)
                    parts += [ids[a:b], end]
                    held += b - a + 1
                    if held >= SHARD_TOKENS:
                        yield closed()
                        names, lengths, parts, held, shards = [], [], [], 0, shards + 1
        if names:
            yield closed()

    rows = ordered.mapInArrow(write, "part int, shard long, n_documents long, n_tokens long, data binary")
    rows.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


_SHARD = pa.schema(
    [
        ("part", pa.int32()),
        ("shard", pa.int64()),
        ("n_documents", pa.int64()),
        ("n_tokens", pa.int64()),
        ("data", pa.binary()),
    ]
)
SHARD_COLUMNS = "part int, shard long, n_documents long, n_tokens long, data binary"


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """The shards under `path`, one row each."""
    ship(spark)
    return spark.read.schema(SHARD_COLUMNS).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, shard and start, the ids of all shards before it: sums within a part, then over the parts' totals."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = (
        shards.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return (
        shards.select("part", "shard", own.alias("own"))
        .join(parts, "part")
        .select("part", "shard", (F.col("before") + F.col("own")).alias("start"))
    )


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document in the shards, end mark included.

    `start` counts the ids of all documents before it, in all shards.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column("start").to_pylist(), batch.column("data").to_pylist()):
                names, bounds, matrix = open_shard(raw)
                wide = matrix.whole().astype("<u4")
                for at in range(0, len(names), 4096):
                    own = bounds[at : at + 4097]
                    pairs = list(zip(own[:-1].tolist(), own[1:].tolist()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[at : at + 4096], pa.int64()),
                            pa.array(own[:-1] + start),
                            pa.array(np.diff(own)),
                            pa.array([wide[a:b].tobytes() for a, b in pairs], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    # stored, the starts have a known size: while that is small Catalyst sends them to the shards, which stay in place
    placed = shards.join(settle(shard_starts(shards)), ["part", "shard"])
    return placed.select("start", "data").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_counts(shards: DataFrame, tokens: Iterable[int]) -> DataFrame:
    """token and n, how often each of `tokens` occurs, from ranks alone; every token asked for has a row."""
    asked = np.array(sorted(set(tokens)), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for raw in batch.column("data").to_pylist():
                matrix = open_shard(raw)[2]
                total += np.array([matrix.count(token) for token in asked.tolist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(total)], names=["token", "n"])

    every = shards.sparkSession.createDataFrame([(int(t),) for t in asked], "token long")
    found = shards.select("data").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return every.join(found, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def token_occurrences(shards: DataFrame, tokens: Iterable[int]) -> DataFrame:
    """token, doc_id and place (from 0 in the document) of every occurrence of `tokens`, by select in each shard."""
    asked = sorted(set(map(int, tokens)))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("data").to_pylist():
                names, bounds, matrix = open_shard(raw)
                known = pa.array(names, pa.int64())
                for token in asked:
                    where = matrix.occurrences(token)
                    for at in range(0, len(where), LOOKED_UP):
                        own = where[at : at + LOOKED_UP]
                        doc = np.searchsorted(bounds, own, side="right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(own), token)), known.take(pa.array(doc)), pa.array(own - bounds[doc])],
                            names=["token", "doc_id", "place"],
                        )

    return shards.select("data").mapInArrow(locate, "token long, doc_id long, place long")


def token_slice(shards: DataFrame, first: int, n: int) -> DataFrame:
    """start, ids: the ids of the corpus from position `first` on, `n` of them, a row for each shard that has some."""
    spans = shards.join(shard_starts(shards), ["part", "shard"]).filter(
        (F.col("start") < first + n) & (F.col("start") + F.col("n_tokens") > first)
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column("start").to_pylist(), batch.column("data").to_pylist()):
                matrix = open_shard(raw)[2]
                a, b = max(first - start, 0), min(first + n - start, matrix.n)
                ids = matrix.access(np.arange(a, b)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start + a], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["start", "ids"]
                )

    return spans.select("start", "data").mapInArrow(read, "start long, ids array<long>")
