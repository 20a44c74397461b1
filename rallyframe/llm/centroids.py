"""Centroid clustering of integer vectors: Walsh-Hadamard transforms compared coarse to fine, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.inputs import column, ship
from rallyframe.session import settle

#: Largest magnitude of a component: the transform, squared differences and their sums then fit 64 bits.
LARGEST = 1 << 24
#: Rows that are compared at a time.
SLICE_ROWS = 8192


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 64):
    """vec_id and v, the components as integers floor(scale * x), of the vectors that can be used.

    Those have exactly `size` components, none null, NaN or infinite; a null vector has none. Null ids stay. Other
    columns are left out, so their names cannot clash. An empty table gives an empty result. A component beyond 2^24
    after scaling has no exact distance in 64 bits: the query that meets one fails and says so.
    """
    x = column(vector).cast("array<double>")
    usable = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        rows.select(column(vec_id).cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.coalesce(F.col("x").isNotNull() & usable, F.lit(False)))
        .select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    )


def hadamard(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, its rows by the number of their sign changes: coarse ones first."""
    if size & (size - 1) or size < 1:
        raise ValueError(f"{size} components: not a power of two")
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[np.argsort((np.diff(matrix) != 0).sum(1), kind="stable")]


def steps(size: int) -> list[tuple[int, int]]:
    """The ranges of coefficients that are added in turn: 1, 1, 2, 4 and so on, to all of them."""
    ends = [1]
    while ends[-1] < size:
        ends.append(min(2 * ends[-1], size))
    return list(zip([0, *ends[:-1]], ends))


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centre of each point, `size` times its squared distance, differences computed), all transformed.

    Sums of squared coefficient differences only grow. After each range of coefficients the centre that is ahead is
    worked out in full, and every centre whose part already exceeds the best of those is strictly worse and goes. Those
    that are left are finished over all coefficients, so the result is exact; of equal centres the smaller number wins.
    """
    n, k = len(points), len(centres)
    size = points.shape[1]
    bound = np.full(n, np.iinfo(np.int64).max)
    row, centre = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    sums = np.zeros(n * k, np.int64)
    work = 0
    for low, high in steps(size):
        gap = points[row, low:high] - centres[centre, low:high]
        sums = sums + (gap * gap).sum(1)
        work += gap.size
        # each point's centre ahead: the first of its least sums; a point never loses all of its centres
        head = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(sums, head) if n else sums
        first = np.flatnonzero(sums == np.repeat(least, np.diff(np.append(head, len(row)))))
        first = first[np.flatnonzero(np.diff(row[first], prepend=-1))]
        if high == size:
            return centre[first], sums[first], work
        gap = points[:, high:] - centres[centre[first], high:]
        bound = np.minimum(bound, least + (gap * gap).sum(1))
        work += gap.size
        live = np.flatnonzero(sums <= bound[row])
        row, centre, sums = row[live], centre[live], sums[live]
    raise AssertionError("the last range ends with all coefficients")


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), size)
    if len(values) and (values.max() > LARGEST or values.min() < -LARGEST):
        raise ValueError(f"a component beyond {LARGEST}: squared distances would not fit 64 bits")
    return values


def _slices(batches: Iterator[pa.RecordBatch], size: int):
    """(ids, vectors) of some rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield part.column("vec_id"), _matrix(part, size)


def _first_centres(vectors: DataFrame, n: int, seed: str) -> list[list[int]]:
    """The vectors with the least hashes of their ids; of equal ids the least vector comes first. At most n rows."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.filter("vec_id IS NOT NULL").select(digest.alias("digest"), "v").orderBy("digest", "v").limit(n)
    return [list(row["v"]) for row in rows.collect()]


def centre_clusters(rows: DataFrame, n: int = 16, rounds: int = 3, seed: str = "1:", size: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of `integer_vectors`.

    Centres start as the `n` vectors with the least sha256 of `seed` and their id. A round assigns every vector to its
    nearest centre (squared Euclidean distance, of equals the smaller number) and moves each centre that has vectors to
    the componentwise floor of their mean; then vectors are assigned once more. inertia sums the distances.

    What the driver and every task hold are the centres and, a round, one sum for each centre and component: numbers
    that the parameters bound. Vectors are read where they lie and never grouped, so no cluster's size matters.
    Repeated rows and ids are vectors of their own; null ids are assigned but are no starting centres; with fewer
    vectors than `n` there are fewer centres, and without an id at all clusters and distances are null.
    """
    ship(rows.sparkSession)
    vectors = settle(rows.select("vec_id", "v"))
    centres = _first_centres(vectors, n, seed)
    if not centres:
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        nulls = [F.lit(None).cast(kind).alias(name) for name, kind in (part.split() for part in empty.split(", "))]
        return vectors.select("vec_id", *nulls)
    transform = hadamard(size)

    def transformed(x: np.ndarray) -> np.ndarray:
        # numbers below 2^53 are exact in doubles, whose products are the fast ones
        return (x.astype(np.float64) @ transform.T.astype(np.float64)).astype(np.int64)

    def placed(own: list[list[int]]):
        return transformed(np.array(own, np.int64).reshape(len(own), size))

    for _ in range(rounds):
        known = placed(centres)

        def add_up(batches: Iterator[pa.RecordBatch], known: np.ndarray = known) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(known), size), np.int64)
            counts = np.zeros(len(known), np.int64)
            for _, values in _slices(batches, size):
                cluster = nearest(transformed(values), known)[0]
                counts += np.bincount(cluster, minlength=len(known))
                order = np.argsort(cluster, kind="stable")
                present, first = np.unique(cluster[order], return_index=True)
                sums[present] += np.add.reduceat(values[order], first)
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(full, size), pa.int32()),
                    pa.array(np.tile(np.arange(size), len(full)), pa.int32()),
                    pa.array(sums[full].reshape(-1)),
                    pa.array(np.repeat(counts[full], size)),
                ],
                names=["cluster", "component", "total", "n"],
            )

        parts = vectors.mapInArrow(add_up, "cluster int, component int, total long, n long")
        total = parts.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for row in total.collect():  # n * size rows
            centres[row["cluster"]][row["component"]] = row["total"] // row["n"]

    known = placed(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in _slices(batches, size):
            cluster, far, _ = nearest(transformed(values), known)
            # by Parseval a transformed distance is `size` times the plain one
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster, pa.int32()), pa.array(far // size)], names=["vec_id", "cluster", "distance"]
            )

    found = settle(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    sums = {row["cluster"]: row["own"] for row in found.groupBy("cluster").agg(F.sum("distance").alias("own")).collect()}
    table = [
        (k, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest())
        for k in sorted(sums)
    ]
    about = rows.sparkSession.createDataFrame(
        table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
