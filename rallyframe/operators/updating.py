"""Point-by-point Bayesian updating: class counts so far on top of a model's probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.ordered import Ordered, count_before


def add_counts_so_far(rows: Ordered, actual: str, classes: Sequence[str], name: str = "seen") -> Ordered:
    """``name``: how often each class occurred in the earlier rows of the group, as one array in class order.

    The vector is a sum of the earlier rows, so blocks of a large group carry theirs into the next ones. A class that is
    not listed, or NULL, counts nowhere. All entries share one window.
    """
    parts = [f"__{name}_{place}" for place in range(len(classes))]
    counts = {part: count_before(F.col(actual) == F.lit(label)) for part, label in zip(parts, classes)}
    return rows.scan(**counts).map(
        lambda df: df.withColumn(name, F.array(*[F.col(part) for part in parts])).drop(*parts)
    )


def updated(prior: Column, seen: Column, strength: float, size: int) -> Column:
    """Mean of the Dirichlet distribution that starts as ``strength`` times the prior and has seen the counts.

    Rows without a prior have no result; a strength of 0 leaves the counts' own shares, NULL before the first.
    """
    earlier = sum((F.get(seen, place) for place in range(size)), F.lit(0))
    whole = F.lit(float(strength)) + earlier
    shares = [(F.lit(float(strength)) * F.get(prior, place) + F.get(seen, place)) / whole for place in range(size)]
    return F.when(prior.isNotNull() & (whole > 0), F.array(*shares))


def add_updated(df: DataFrame, strength: float, size: int, probabilities: str = "probability", seen: str = "seen") -> DataFrame:
    """The probability column after the counts of ``seen``."""
    return df.withColumn(probabilities, updated(F.col(probabilities), F.col(seen), strength, size))
