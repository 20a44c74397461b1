"""P(class | key) by counting training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.groups import counts, shares
from rallyframe.operators.labels import class_list
from rallyframe.session import settle


@dataclass(frozen=True)
class FrequencyModel:
    """``table`` has one row per key: keys, probability."""

    keys: list[str]
    classes: list[str]
    table: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """Add classes and probability; keys never seen in training have no probability."""
        names = F.array(*[F.lit(name) for name in self.classes])
        return df.join(self.table, self.keys, "left").withColumn("classes", names)


def frequency_rows(train: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """(keys, class, n, p) for every class seen with the key."""
    return shares(counts(train, [*keys, target]), keys, share="p")


def fit_frequency_model(train: DataFrame, keys: Sequence[str], target: str) -> FrequencyModel:
    """Count classes per key in one pass over ``train``.

    For a target with too many classes to hold one entry each, ``frequency_rows`` gives the same numbers
    in long form.
    """
    counted = settle(counts(train, [*keys, target]))
    classes = class_list(counted, target)
    per_key = counted.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(target), F.col("n")))).alias("__n"),
        F.sum("n").alias("__total"),
    )
    share = F.transform(
        F.array(*[F.lit(name) for name in classes]),
        lambda name: F.coalesce(F.element_at("__n", name) / F.col("__total"), F.lit(0.0)),
    )
    return FrequencyModel(list(keys), classes, per_key.select(*keys, share.alias("probability")))


@dataclass(frozen=True)
class SparseFrequencyModel:
    """P(class | key) in long form, one row for each class seen with a key: no class list, whatever their number."""

    keys: list[str]
    shares: DataFrame
    known: DataFrame
    first_class: str | None

    def available_probabilities(self, df: DataFrame, row_key: Sequence[str], available: str) -> DataFrame:
        """Add ``probability``, a map from each available class to its share, and ``first_class``.

        ``available`` is an array of labels of bounded length; NULL entries name no class. Its entries are looked up by one
        join, and a row's map has at most as many of them. Rows whose keys training never saw have a NULL map.
        ``row_key`` must be unique.
        """
        listed = df.select(
            *row_key, *self.keys, F.explode(F.array_distinct(F.array_compact(available))).alias("__class")
        )
        found = (
            listed.join(self.shares.withColumnRenamed("class", "__class"), [*self.keys, "__class"])
            .groupBy(*row_key)
            .agg(F.map_from_entries(F.collect_list(F.struct("__class", "p"))).alias("__found"))
        )
        nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        whole = df.join(found, list(row_key), "left").join(self.known, self.keys, "left")
        return whole.withColumns(
            {
                "probability": F.when(F.col("__known"), F.coalesce("__found", nothing)),
                "first_class": F.lit(self.first_class),
            }
        ).drop("__found", "__known")


def fit_sparse_frequency_model(train: DataFrame, keys: Sequence[str], target: str) -> SparseFrequencyModel:
    """Count classes per key; the table is stored and stays distributed. Only the first label comes to the driver."""
    rows = frequency_rows(train, keys, target)
    shares_ = settle(rows.select(*keys, F.col(target).cast("string").alias("class"), "p"))
    known = settle(shares_.select(*keys).distinct().withColumn("__known", F.lit(True)))
    first = shares_.agg(F.min("class")).first()[0]
    return SparseFrequencyModel(list(keys), shares_, known, first)
