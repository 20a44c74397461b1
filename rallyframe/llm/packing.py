"""Hierarchical best-fit packing of token pieces into sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.inputs import documents, result_schema, ship
from rallyframe.llm.wordbpe import encoded
from rallyframe.session import settle

#: Items that a node packs, on average; the part of its bins that a level has to save for another one to follow.
LEAF_ITEMS, SAVED = 16_384, 1 / 256
#: A bin with at most so many free places is nearly full and final.
SLACK = 16


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document's pieces.

    A document is its token ids and `end_id`; only one longer than `capacity` is cut, into whole pieces and a rest.
    Null and empty texts are `end_id` alone. Repeated rows are documents of their own. Other columns are left out.
    """
    source = documents(docs)
    schema = result_schema(source, "piece int, start long, length long, ids binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id")
            for first, _, ids, bounds in encoded(batch.column("text"), tokenizer):
                rows, piece, start, length, blobs = [], [], [], [], []
                wide = ids.astype("<u4")
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = np.append(wide[a:b], np.uint32(end_id)).astype("<u4")
                    for n, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append(first + k)
                        piece.append(n)
                        start.append(at)
                        length.append(len(part))
                        blobs.append(part.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(rows, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return source.mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin): longest first, into the fullest bin that has room."""
    places = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    mask = 0  # bit r: some bin has exactly r free places
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        fitting = mask >> need
        if fitting:
            r = need + (fitting & -fitting).bit_length() - 1
            place = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            place, r = len(free), capacity
            free.append(capacity)
        places[k], offsets[k] = place, capacity - r
        r -= need
        free[place] = r
        if r:
            room[r].append(place)
            mask |= 1 << r
    return places, offsets, capacity - np.array(free, np.int64)


def _node(item: str, capacity: int, level: int):
    """Packs one node's items; a bin's number holds the level, the node and its place there."""

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(item)
        places, offsets, fills = best_fit(rows.column("length").to_numpy(), capacity)
        node = key[0].as_py()
        goes_on = fills < capacity - SLACK  # nearly full bins are final, all others are items of the next level
        return pa.table(
            {
                item: rows.column(item),
                "bin": pa.array((level << 56) + (node << 20) + places),
                "bin_offset": pa.array(offsets),
                "fill": pa.array(fills[places]),
                "goes_on": pa.array(goes_on[places]),
            }
        )

    return pack


_PACKED = "bin long, bin_offset long, fill long, goes_on boolean"


def packed(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """`pieces` (any columns and a `length` of 1 to `capacity`) with `sequence_id` and `offset`.

    Leaves of about LEAF_ITEMS pieces are packed on their own. Nearly full bins are final; all underfull ones go on as
    items of the next level, dealt anew over as many nodes as their number needs, until one node is left or a level has
    saved hardly any bin: then those that are left do not fit together. No task sees more than a node's items.
    An empty table gives an empty result; pieces that equal each other in every column may swap places.
    """
    ship(pieces.sparkSession)
    kept = [name for name in pieces.columns if name.lower() not in ("sequence_id", "offset")]
    items = settle(
        pieces.select(
            F.struct(*[F.col(f"`{name}`") for name in kept]).alias("row"),
            F.col("length").cast("long").alias("length"),
            F.monotonically_increasing_id().alias("item"),
        )
    )
    leaves = max(1, -(-items.count() // LEAF_ITEMS))
    # the stored item number spreads the pieces evenly, copies of a row included
    leaf = F.pmod(F.xxhash64("item"), F.lit(leaves)).alias("node")
    bins = settle(
        items.select("item", "length", leaf)
        .groupBy("node")
        .applyInArrow(_node("item", capacity, 0), f"item long, {_PACKED}")
    )
    maps: list[DataFrame] = []
    level, nodes = 0, leaves
    below = bins
    while nodes > 1:
        level += 1
        open_bins = settle(
            below.filter("goes_on").select(F.col("bin").alias("child"), F.col("fill").alias("length")).distinct()
        )
        before = open_bins.count()
        nodes = max(1, -(-before // LEAF_ITEMS))
        node = F.pmod(F.xxhash64("child", F.lit(level)), F.lit(nodes)).alias("node")
        below = settle(
            open_bins.select("child", "length", node)
            .groupBy("node")
            .applyInArrow(_node("child", capacity, level), f"child long, {_PACKED}")
        )
        maps.append(below)
        if nodes > 1 and before - below.select("bin").distinct().count() < SAVED * before:
            break
    found = bins.select("item", "bin", "bin_offset")
    for into in maps:
        step = into.select(
            F.col("child").alias("bin"), F.col("bin").alias("parent"), F.col("bin_offset").alias("base")
        )
        found = found.join(step, "bin", "left").select(
            "item",
            F.coalesce("parent", "bin").alias("bin"),
            (F.col("bin_offset") + F.coalesce("base", F.lit(0))).alias("bin_offset"),
        )
    return items.join(found, "item").select(
        *[F.col(f"row.`{name}`").alias(name) for name in kept],
        F.col("bin").alias("sequence_id"),
        F.col("bin_offset").alias("offset"),
    )


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, length and the ids of each sequence: pieces with `ids`, put where `places` has them.

    Both need doc_id and piece; documents must have distinct ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        pieces.select("doc_id", "piece", "ids")
        .join(places.select("doc_id", "piece", "length", "offset", "sequence_id"), ["doc_id", "piece"])
        .groupBy("sequence_id")
        .agg(F.sum("length").alias("length"), parts.alias("parts"))
        .select(
            "sequence_id",
            "length",
            F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        )
    )
