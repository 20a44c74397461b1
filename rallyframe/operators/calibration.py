"""How far probabilities can be trusted: Brier score, reliability table, calibration error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of [0, 1] that summarise confidences; bins are made of whole cells.
CELLS = 1 << 14


def brier(probabilities: Column, classes: Column, actual: Column) -> Column:
    """Sum over the classes of (probability - 1 for the actual one, else 0) squared: 0 is best, 2 worst.

    An actual value that is no class, or NULL, adds 1 to the squares of all probabilities.
    """
    squares = F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc + p * p)
    place = F.array_position(classes, actual)
    hit = F.when(place > 0, F.get(probabilities, (place - 1).cast("int"))).otherwise(F.lit(0.0))
    return squares - 2 * hit + 1


def confidence_cells(df: DataFrame, confidence: Column, hit: Column, keys: Sequence[str] = ()) -> DataFrame:
    """keys, cell, n, total (of the confidences) and hits: a summary of at most CELLS rows for each key.

    Summaries of parts of the data add up to the summary of the whole, by summing n, total and hits over equal cells.
    Rows without a confidence are left out.
    """
    cell = F.least(F.floor(confidence * CELLS), F.lit(CELLS - 1)).cast("int")
    rows = df.select(*keys, confidence.alias("confidence"), cell.alias("cell"), hit.cast("bigint").alias("hit"))
    return (
        rows.where(F.col("confidence").isNotNull())
        .groupBy(*keys, "cell")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("confidence").alias("total"),
            F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"),
        )
    )


def merged_cells(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Summaries of several parts, put one under the other, as the summary of the whole."""
    return cells.groupBy(*keys, "cell").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("hits").alias("hits")
    )


def reliability(cells: DataFrame, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, bin, n, mean_confidence and hit_rate of bins of near equal mass, least confident first.

    A cell lies in the bin that the rows before it reach; bins that a large cell jumps over are absent. The window runs
    over the summary, whose size does not grow with the data.
    """
    here = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(here.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(here)
    placed = cells.withColumn("__before", before).withColumn("__whole", whole)
    placed = placed.withColumn("bin", F.expr(f"CAST(__before * {bins} div __whole AS INT)"))
    return placed.groupBy(*keys, "bin").agg(
        F.sum("n").alias("n"),
        (F.sum("total") / F.sum("n")).alias("mean_confidence"),
        (F.sum("hits") / F.sum("n")).alias("hit_rate"),
    )


def calibration_error(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys and calibration_error: the mean distance of confidence and hit rate over the bins, by their rows."""
    gap = F.abs(F.col("mean_confidence") - F.col("hit_rate"))
    return table.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("calibration_error"))
