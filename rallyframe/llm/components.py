"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.session import settle

#: Rows of one key that a join takes in one place.
SHARE_ROWS = 1000


def hot_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and `shares`, how many places their rows need, of the keys with more than SHARE_ROWS rows.

    The table is stored, so a join knows its size and sends it to the rows while it is small.
    """
    counted = rows.groupBy(*keys).count().filter(F.col("count") > SHARE_ROWS)
    return settle(counted.select(*keys, F.expr(f"count div {SHARE_ROWS} + 1").cast("int").alias("shares")))


def spread(rows: DataFrame, hot: DataFrame, *keys: str, by: str) -> DataFrame:
    """`rows` with `share`: rows of a hot key are dealt over its places by a hash of `by`."""
    shares = F.coalesce("shares", F.lit(1))
    return rows.join(hot, list(keys), "left").withColumn("share", F.pmod(F.xxhash64(by), shares).cast("int")).drop("shares")


def repeated(rows: DataFrame, hot: DataFrame, *keys: str) -> DataFrame:
    """`rows` with `share`, once for each place of their key."""
    shares = F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)
    return rows.join(hot, list(keys), "left").withColumn("share", F.explode(shares)).drop("shares")


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node it reaches) for every end of the links `a`, `b` (64-bit numbers).

    Each round takes the least label around every node and then the label of that label; the table of a round is stored
    and its lineage ends there. The labels stay distributed, and the number of rounds follows the logarithm of the
    longest chain. A node with very many links, and a label with very many nodes, are dealt over several places of a
    join. No links give an empty result.
    """
    pairs = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = settle(pairs)
    linked = hot_keys(both, "b")
    dealt = settle(spread(both, linked, "b", by="a"))
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = (
            dealt.join(repeated(labels.withColumnRenamed("node", "b"), linked, "b"), ["b", "share"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = settle(labels.join(around, "node").select("node", "label", F.least("label", "near").alias("new")))
        named = hot_keys(lower, "new")
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = settle(
            spread(lower, named, "new", by="node")
            .join(repeated(jump, named, "new"), ["new", "share"], "left")
            .select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new"))
        )
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.filter("new < label").isEmpty():
            return labels.withColumnRenamed("label", "component")
