"""Expressions over class probabilities as a map from label to probability; a class that is not in it has 0.

No class list is needed, so the number of classes may grow with the data. ``first_class`` is what the dense form calls
the first class: the top pick of a row without any mass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(probabilities: Column) -> Column:
    """Sum in label order, as the dense form adds."""
    return F.aggregate(_in_order(probabilities), F.lit(0.0), lambda acc, entry: acc + entry["value"])


def _in_order(probabilities: Column) -> Column:
    return F.array_sort(F.map_entries(probabilities))


def mask(probabilities: Column, available: Column) -> Column:
    """The classes that are in ``available``, with the rest of the map left out; not yet renormalised."""
    return F.map_filter(
        probabilities, lambda label, p: (p > 0) & F.coalesce(F.array_contains(available, label), F.lit(False))
    )


def renormalise(probabilities: Column, mass: Column) -> Column:
    """Shares of the mass, which should be a column of its own; a map without mass stays as it is."""
    return F.when(mass > 0, F.transform_values(probabilities, lambda _, p: p / mass)).otherwise(probabilities)


def entropy(probabilities: Column) -> Column:
    """Shannon entropy in nats; 0.0 without any entry."""
    return F.aggregate(
        _in_order(probabilities),
        F.lit(0.0),
        lambda acc, entry: acc - F.when(entry["value"] > 0, entry["value"] * F.ln(entry["value"])).otherwise(F.lit(0.0)),
    ) + F.lit(0.0)


def top_class(probabilities: Column, first_class: Column) -> Column:
    """Label of the largest entry, the smallest label of equals; ``first_class`` where there is no mass."""
    largest = F.array_max(F.map_values(probabilities))
    best = F.array_min(F.map_keys(F.map_filter(probabilities, lambda _, p: p == largest)))
    return F.when(largest > 0, best).otherwise(first_class)


def probability_of(probabilities: Column, actual: Column) -> Column:
    """Probability of the actual class; 0.0 where the map does not hold it."""
    return F.coalesce(F.element_at(probabilities, actual), F.lit(0.0))
