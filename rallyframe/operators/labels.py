"""Label dictionaries: fit an index over distinct labels, apply it, count what it does not know."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.ordered import Ordered, row_number
from rallyframe.schema import UNSEEN
from rallyframe.session import settle

# The range of label order that a stored label was written in.
RANGE = "__range"

# A dictionary up to this size, entries and bytes of labels and keys, is sent along as a value, once for each column.
MAP_ENTRIES, MAP_BYTES = 1 << 14, 1 << 20


def distinct_labels(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, label).where(F.col(label).isNotNull()).distinct()


def spread_labels(labels: DataFrame, label: str, ranges: int | None = None) -> DataFrame:
    """Labels stored in ranges of their order, whose number follows the amount of labels unless it is given.

    No task sees all labels, and the stored ranges do not change when a task is repeated.
    """
    by_range = labels.repartitionByRange(F.col(label)) if ranges is None else labels.repartitionByRange(ranges, label)
    return settle(by_range.withColumn(RANGE, F.spark_partition_id()))


def rank_labels(spread: DataFrame, label: str, keys: Sequence[str] = (), index: str = "idx") -> DataFrame:
    """0-based place of every label in code-point order, per combination of keys, range by range."""
    # one fixed key stands in where the numbering is not per key
    rows = spread.withColumn("__all", F.lit(0))
    numbered = Ordered.by_block(rows, ["__all", *keys], [label], F.col(RANGE)).scan(__place=row_number()).df
    return numbered.select(*keys, label, (F.col("__place") - 1).cast("int").alias(index))


def fit_dictionary(df: DataFrame, label: str, keys: Sequence[str] = (), index: str = "idx") -> DataFrame:
    """Dictionary (keys, label, index) of the labels in one column."""
    spread = spread_labels(distinct_labels(df, label, keys), label)
    return settle(rank_labels(spread, label, keys, index))


def fit_dictionaries(
    df: DataFrame, columns: Mapping[str, Sequence[Column]], label: str, keys: Sequence[str] = (), index: str = "idx"
) -> dict[str, DataFrame]:
    """Several dictionaries in one pass: name -> the columns that share it."""
    pooled = [
        F.struct(F.lit(name).alias("__dictionary"), column.alias(label))
        for name, members in columns.items()
        for column in members
    ]
    labelled = df.select(*keys, F.inline(F.array(*pooled)))
    fitted = fit_dictionary(labelled, label, [*keys, "__dictionary"], index)
    return {name: fitted.where(F.col("__dictionary") == name).drop("__dictionary") for name in columns}


def pool_labels(df: DataFrame, columns: Mapping[str, Column], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """The labels of several columns in one."""
    return df.select(*keys, F.explode(F.array(*columns.values())).alias(label))


def fit_joint_dictionary(
    df: DataFrame, columns: Mapping[str, Column], label: str, keys: Sequence[str] = (), index: str = "idx"
) -> DataFrame:
    """One dictionary shared by several columns."""
    return fit_dictionary(pool_labels(df, columns, label, keys), label, keys, index)


def encode(
    df: DataFrame,
    dictionary: DataFrame,
    value: Column,
    output: str,
    label: str,
    keys: Sequence[str] = (),
    index: str = "idx",
    unseen: int | None = UNSEEN,
) -> DataFrame:
    """Add the index of ``value``; labels the dictionary does not hold get ``unseen`` (None = NULL)."""
    left = df.withColumn("__label", value)
    known = dictionary.select(*keys, F.col(label).alias("__label"), F.col(index).alias("__index"))
    found = F.col("__index") if unseen is None else F.coalesce("__index", F.lit(unseen))
    return (
        left.join(known, [*keys, "__label"], "left")
        .withColumn(output, found.cast("int"))
        .drop("__label", "__index")
    )


def encode_all(
    df: DataFrame,
    dictionary: DataFrame,
    values: Mapping[str, Column],
    label: str,
    keys: Sequence[str] = (),
    index: str = "idx",
    unseen: int | None = UNSEEN,
) -> DataFrame:
    """``encode`` for several columns that share a stored dictionary: output name -> value.

    A dictionary measured to be small becomes one value, a map of hash buckets, that every row reads: no join and no
    shuffle, however many columns there are. A larger one is joined for each column.
    """
    names = [*keys, label]
    size = dictionary.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(sum(F.octet_length(F.col(name).cast("string")) for name in names)), F.lit(0)).alias("n_bytes"),
    ).first()
    columns = [name for name in df.columns if name not in values]
    if size["n"] > MAP_ENTRIES or size["n_bytes"] > MAP_BYTES:
        for output, value in values.items():
            df = encode(df, dictionary, value, output, label, keys, index, unseen)
        return df.select(*columns, *values)
    # Spark reads a map from its start, so there are two levels of buckets, with about two entries in each of the lower
    n_buckets = max(1, round((size["n"] / 2) ** 0.5))
    levels = "__upper", "__lower"

    def buckets(wanted: Sequence[Column]) -> list[Column]:
        found = F.pmod(F.xxhash64(*wanted), F.lit(n_buckets * n_buckets))
        return [F.floor(found / n_buckets).cast("int"), F.pmod(found, F.lit(n_buckets)).cast("int")]

    own = [F.col(name) for name in names]
    held = dictionary.na.drop(subset=names).select(
        *[bucket.alias(level) for level, bucket in zip(levels, buckets(own))],
        F.struct(F.struct(*own), F.col(index).cast("int")).alias("__held"),
    )
    for level in reversed(range(len(levels))):
        inside = F.map_from_entries(F.collect_list("__held"))
        held = held.groupBy(*levels[: level + 1]).agg(inside.alias("__inside"))
        held = held.select(*levels[:level], F.struct(levels[level], "__inside").alias("__held"))
    whole = held.agg(F.map_from_entries(F.collect_list("__held"))).scalar()

    def place(value: Column) -> Column:
        wanted = [*[F.col(name) for name in keys], value]
        upper, lower = buckets(wanted)
        found = whole[upper][lower][F.struct(*wanted)]
        return found if unseen is None else F.coalesce(found, F.lit(unseen))

    return df.withColumns({name: place(value) for name, value in values.items()})


def class_list(dictionary: DataFrame, label: str) -> list[str]:
    """Labels in code-point order, which is index order, as a list for models that hold one entry per class.

    It is as long as one row's probabilities; targets too wide for that have ``frequency_rows``.
    """
    return [row[0] for row in dictionary.select(label).distinct().orderBy(label).collect()]


def class_counts(df: DataFrame, dictionary: DataFrame, target: str, label: str, index: str = "idx") -> DataFrame:
    """Rows per class; classes without rows are listed with 0."""
    counted = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias(index)).agg(
        F.count(F.lit(1)).alias("__n")
    )
    return dictionary.join(counted, index, "left").select(
        index, label, F.coalesce("__n", F.lit(0)).alias("n")
    )
