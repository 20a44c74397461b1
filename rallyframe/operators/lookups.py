"""Lookups that keep every row of the left side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_role(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str, columns: Mapping[str, str]) -> DataFrame:
    """Left join of one dimension under a role; ``columns`` maps its columns to role names.

    No broadcast hint: Catalyst broadcasts the dimension when its measured size allows it and
    otherwise joins by shuffle, where the adaptive planner splits hot keys.
    """
    role = dimension.select(
        F.col(dimension_key).alias("__role_key"),
        *[F.col(source).alias(target) for source, target in columns.items()],
    )
    return df.join(role, df[key] == role["__role_key"], "left").drop("__role_key")


def names_by_id(df: DataFrame, keys: Sequence[str], player: str, name: str, order: str) -> DataFrame:
    """One name per id: the first one in order, so that a second spelling cannot multiply rows."""
    return (
        df.where(F.col(player).isNotNull() & F.col(name).isNotNull())
        .groupBy(*keys, player)
        .agg(F.min_by(name, order).alias(name))
    )


def ids_with_several_names(df: DataFrame, keys: Sequence[str], player: str, name: str) -> DataFrame:
    return (
        df.where(F.col(player).isNotNull() & F.col(name).isNotNull())
        .groupBy(*keys, player)
        .agg(F.countDistinct(name).alias("n_names"))
        .where(F.col("n_names") > 1)
    )
