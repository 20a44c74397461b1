"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.session import settle


def byte_shards(rows: DataFrame, size: Column, order: list[str], n_shards: int) -> DataFrame:
    """`rows` with `size`, `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in the shard).

    The rows are range-partitioned by `order`; each partition's total is summed up, the totals' prefix sums (one row
    for each partition) give every row its global byte offset, and the shard is the one in whose equal share of all
    bytes the row's middle lies. So shards are contiguous in `order` and differ from the target by at most one row.

    Null sizes count as 0 and nulls come first in the order. Rows equal in `order` may take each other's place, also
    when one value holds most rows: the reading position is a last key, so such a value is split over partitions too.
    An empty table gives an empty result. Columns named `size`, `shard` and `slot` are replaced; others stay.
    """
    kept = [name for name in rows.columns if name.lower() not in ("size", "shard", "slot")]
    every = F.struct(*[F.col(f"`{name}`") for name in kept])
    keys = [F.col(f"row.`{name}`") for name in order]
    placed = settle(
        rows.select(
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
            every.alias("row"),
            F.monotonically_increasing_id().alias("tie"),
        )
        .repartitionByRange(*keys, "tie")
        .withColumn("part", F.spark_partition_id())
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = (
        placed.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(whole).alias("all_bytes"),
        )
    )
    running = Window.partitionBy("part").orderBy(*keys, "tie").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        placed.join(parts, "part")
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(running))
        .withColumn("at", F.col("rows_before") + F.count(F.lit(1)).over(running) - 1)
        .withColumn(
            "shard",
            F.least(
                F.expr(f"(2 * end - size) * {n_shards} div greatest(2 * all_bytes, 1)"), F.lit(n_shards - 1)
            ).cast("int"),
        )
    )
    firsts = cut.groupBy("shard").agg(F.min("at").alias("first"))  # at most n_shards rows
    return cut.join(F.broadcast(firsts), "shard").select(
        *[F.col(f"row.`{name}`").alias(name) for name in kept],
        "size",
        "shard",
        (F.col("at") - F.col("first")).alias("slot"),
    )
