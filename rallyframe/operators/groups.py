"""First rows, counts, shares and rates per group. All of them aggregate map-side before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """Which rows may play a role and the columns to take from the first of them."""

    condition: Column
    columns: Mapping[str, Column]


def first_by_role(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    roles: Mapping[str, Role],
    required: Sequence[str] = (),
) -> DataFrame:
    """One row per group with the columns of the first row of every role.

    A single aggregation does the work of one first-row-per-group query per role and the joins
    between them: a required role acts as an inner join, any other as a left join. A role's columns
    travel as one struct, so a NULL field never lets two rows mix.
    """
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    wanted = None
    for role in roles.values():
        wanted = role.condition if wanted is None else wanted | role.condition
    firsts = [
        F.min_by(
            F.struct(*[column.alias(name) for name, column in role.columns.items()]),
            F.when(role.condition, place),
        ).alias(f"__{name}")
        for name, role in roles.items()
    ]
    points = df.where(wanted).groupBy(*keys).agg(*firsts)
    for name in required:
        points = points.where(F.col(f"__{name}").isNotNull())
    return points.select(
        *keys,
        *[F.col(f"__{name}")[column].alias(column) for name, role in roles.items() for column in role.columns],
    )


def first_per_group(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The first row of each group by ``order``."""
    taken = F.min_by(F.struct(*columns), F.col(order)).alias("__first")
    return df.groupBy(*keys).agg(taken).select(*keys, "__first.*")


def counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per combination of keys; rows with a NULL key are left out."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def shares(counted: DataFrame, within: Sequence[str], count: str = "n", share: str = "share") -> DataFrame:
    """Each count as a share of its group's total.

    The total comes from an aggregation joined back, not from a window, so a group with very many
    members is never gathered in one task.
    """
    totals = counted.groupBy(*within).agg(F.sum(count).alias("__total"))
    return (
        counted.join(totals, list(within))
        .withColumn(share, F.col(count) / F.col("__total"))
        .drop("__total")
    )


def top_member(counted: DataFrame, within: Sequence[str], member: str, measure: str) -> DataFrame:
    """The member with the largest measure per group; the smaller member wins a tie."""
    best = F.min(F.struct((-F.col(measure)).alias("__rank"), F.col(member))).alias("__best")
    return (
        counted.groupBy(*within)
        .agg(best)
        .select(*within, F.col("__best")[member].alias(member), (-F.col("__best")["__rank"]).alias(measure))
    )


def value_counts(df: DataFrame, column: str, by: str = "count") -> DataFrame:
    """Rows per value, by falling count or by rising value."""
    counted = counts(df, [column])
    order = [F.col("n").desc(), F.col(column)] if by == "count" else [F.col(column)]
    return counted.orderBy(*order)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def flag_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Count and rate of each boolean column, one row per flag; NULLs count in neither."""
    measures = []
    for flag in flags:
        measures.append(F.coalesce(F.sum(F.col(flag).cast("bigint")), F.lit(0)).alias(f"{flag}_n"))
        measures.append(F.avg(F.col(flag).cast("double")).alias(f"{flag}_rate"))
    listed = [
        F.struct(
            F.lit(flag).alias("flag"), F.col(f"{flag}_n").alias("n"), F.col(f"{flag}_rate").alias("rate")
        )
        for flag in flags
    ]
    return df.agg(*measures).select(F.inline(F.array(*listed)))


def unmapped_codes(df: DataFrame, code: str, mapped: str) -> DataFrame:
    """Codes that the fixed table did not know, with their counts."""
    return value_counts(df.where(F.col(mapped).isNull()), code)


def rows_and_members(df: DataFrame, keys: Sequence[str], member: str, rows: str, members: str) -> DataFrame:
    """Rows and distinct members per group in one pass."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(rows),
        F.countDistinct(member).alias(members),
    )


def unseen_labels(df: DataFrame, known: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Labels that occur in ``df`` but not in ``known``."""
    names = [*keys, label]
    return df.select(*names).where(F.col(label).isNotNull()).distinct().join(
        known.select(*names).distinct(), names, "left_anti"
    )


def label_union(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    return left.select(label).union(right.select(label)).where(F.col(label).isNotNull()).distinct()
