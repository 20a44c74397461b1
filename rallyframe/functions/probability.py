"""Expressions over one probability array per row, in class order.

With the number of classes known and small, sums over an array are written out entry by entry, which
Spark compiles; its lambda functions over arrays are interpreted and serve the longer class lists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.schema import EPSILON

# Class lists up to this length are written out.
WRITTEN_OUT = 64


def _fold(probabilities: Column, size: int | None, step: Callable[[Column, Column], Column]) -> Column:
    """Fold the entries from the left, starting at 0.0."""
    if size is None or size > WRITTEN_OUT:
        return F.aggregate(probabilities, F.lit(0.0), step)
    return reduce(step, [F.get(probabilities, place) for place in range(size)], F.lit(0.0))


def total(probabilities: Column, size: int | None = None) -> Column:
    return _fold(probabilities, size, lambda acc, p: acc + p)


def entropy(probabilities: Column, size: int | None = None) -> Column:
    """Shannon entropy in nats over the positive entries; 0.0 when there are none."""
    return _fold(
        probabilities,
        size,
        lambda acc, p: acc - F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0)),
    ) + F.lit(0.0)


def zero_unavailable(probabilities: Column, classes: Sequence[str], available: Column) -> Column:
    """Zero for every class that is not in ``available``; its missing entries match nothing."""

    def kept(p: Column, name: Column) -> Column:
        return F.when(F.array_contains(available, name), p).otherwise(F.lit(0.0))

    names = [F.lit(name) for name in classes]
    if len(names) > WRITTEN_OUT:
        return F.zip_with(probabilities, F.array(*names), kept)
    return F.array(*[kept(F.get(probabilities, place), name) for place, name in enumerate(names)])


def _divided(probabilities: Column, mass: Column, size: int) -> Column:
    """Divide by the mass; an all-zero row stays as it is."""
    if size > WRITTEN_OUT:
        shares = F.transform(probabilities, lambda p: p / mass)
    else:
        shares = F.array(*[F.get(probabilities, place) / mass for place in range(size)])
    return F.when(mass > 0, shares).otherwise(probabilities)


def renormalise(df: DataFrame, name: str, size: int) -> DataFrame:
    """Make a probability column sum to 1 where it has any mass.

    Every step is a column of its own: nested into one expression, the mass would be worked out again
    for each class.
    """
    return (
        df.withColumn("__mass", total(F.col(name), size))
        .withColumn(name, _divided(F.col(name), F.col("__mass"), size))
        .drop("__mass")
    )


def mask(df: DataFrame, name: str, classes: Sequence[str], available: Column) -> DataFrame:
    """Zero the classes missing from ``available`` and renormalise the rest."""
    zeroed = (
        df.withColumn("__available", available)
        .withColumn(name, zero_unavailable(F.col(name), classes, F.col("__available")))
        .drop("__available")
    )
    return renormalise(zeroed, name, len(classes))


def top_class(probabilities: Column, classes: Column) -> Column:
    """Class of the largest entry; the first one wins a tie."""
    return F.get(classes, (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int"))


def positive_count(probabilities: Column) -> Column:
    return F.size(F.filter(probabilities, lambda p: p > 0))


def probability_of(probabilities: Column, classes: Column, actual: Column) -> Column:
    """Entry of the actual class; NULL when it is not a class at all."""
    place = F.array_position(classes, actual)
    return F.when(place > 0, F.get(probabilities, (place - 1).cast("int")))


def log_loss_term(probability: Column) -> Column:
    return -F.ln(F.greatest(F.least(probability, F.lit(1.0 - EPSILON)), F.lit(EPSILON)))
