"""Scored rows to reports: prediction columns, summaries, class report, confusion, log loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions import probability as P
from rallyframe.functions import sparse as S

SUMMARY_METRICS = [
    "overall_accuracy",
    "insystem_accuracy",
    "non_top_rate_all",
    "non_top_rate_insystem",
    "mean_entropy_all",
    "mean_entropy_insystem",
]


def mask_to_available(
    df: DataFrame, class_names: Sequence[str], available: Column, probabilities: str = "probability"
) -> DataFrame:
    """Zero the classes that were not available and renormalise, row by row."""
    return P.mask(df, probabilities, class_names, available)


def add_predictability(
    df: DataFrame,
    actual: str,
    n_classes: int | None = None,
    probabilities: str = "probability",
    classes: str = "classes",
) -> DataFrame:
    """Entropy, most likely class, and whether it was the one chosen."""
    return df.withColumns(
        {
            "pred_entropy": P.entropy(F.col(probabilities), n_classes),
            "top_predicted": P.top_class(F.col(probabilities), F.col(classes)),
        }
    ).withColumns(
        {
            "prediction_correct": F.col("top_predicted") == F.col(actual),
            "chose_non_top": F.col("top_predicted") != F.col(actual),
        }
    )


def add_sparse_predictability(
    df: DataFrame, actual: str, available: Column, probabilities: str = "probability", first_class: str = "first_class"
) -> DataFrame:
    """Mask and renormalise a probability map, then what ``add_predictability`` adds, and the actual class's share."""
    masked = (
        df.withColumn("__available", available)
        .withColumn(probabilities, S.mask(F.col(probabilities), F.col("__available")))
        .withColumn("__mass", S.total(F.col(probabilities)))
        .withColumn(probabilities, S.renormalise(F.col(probabilities), F.col("__mass")))
        .drop("__available", "__mass")
    )
    picked = masked.withColumns(
        {
            "pred_entropy": S.entropy(F.col(probabilities)),
            "top_predicted": S.top_class(F.col(probabilities), F.col(first_class)),
            "p_actual": S.probability_of(F.col(probabilities), F.col(actual)),
        }
    )
    return picked.withColumns(
        {
            "prediction_correct": F.col("top_predicted") == F.col(actual),
            "chose_non_top": F.col("top_predicted") != F.col(actual),
        }
    )


def _summary_columns(in_system: Column) -> list[Column]:
    correct = F.col("prediction_correct").cast("double")
    non_top = F.col("chose_non_top").cast("double")
    entropy = F.col("pred_entropy")
    return [
        F.avg(correct).alias("overall_accuracy"),
        F.avg(F.when(in_system, correct)).alias("insystem_accuracy"),
        F.avg(non_top).alias("non_top_rate_all"),
        F.avg(F.when(in_system, non_top)).alias("non_top_rate_insystem"),
        F.avg(entropy).alias("mean_entropy_all"),
        F.avg(F.when(in_system, entropy)).alias("mean_entropy_insystem"),
    ]


def summarise(df: DataFrame, in_system: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Six means per group, over all rows and over the in-system rows, in one pass."""
    return df.groupBy(*keys).agg(*_summary_columns(in_system))


def listed_metrics(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The summary as (keys, metric, value) rows."""
    return summary.unpivot([F.col(key) for key in keys], list(SUMMARY_METRICS), "metric", "value")


def by_rotation(df: DataFrame, rotation: str, low: int, high: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean entropy and non-top rate of every rotation from ``low`` to ``high``; NULLs where there are no rows.

    The rotations are a fixed short list, so each is a pair of conditional means in one aggregation.
    """
    means, listed = [], []
    for slot in range(low, high + 1):
        here = F.col(rotation) == slot
        entropy, non_top = f"__entropy_{slot}", f"__non_top_{slot}"
        means.append(F.avg(F.when(here, F.col("pred_entropy"))).alias(entropy))
        means.append(F.avg(F.when(here, F.col("chose_non_top").cast("double"))).alias(non_top))
        listed.append(
            F.struct(
                F.lit(slot).alias(rotation),
                F.col(entropy).alias("mean_entropy"),
                F.col(non_top).alias("non_top_rate"),
            )
        )
    return df.groupBy(*keys).agg(*means).select(*keys, F.inline(F.array(*listed)))


def compare_periods(summary: DataFrame, period: str, periods: Sequence[str]) -> DataFrame:
    """One row per metric, one column per period, in the order given."""
    return listed_metrics(summary, [period]).groupBy("metric").pivot(period, list(periods)).agg(F.first("value"))


def confusion_cells(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per (actual, predicted)."""
    return df.groupBy(
        *keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_labels(cells: DataFrame) -> list[str]:
    """The labels of rows and columns in code-point order: those that occur as actual or as predicted."""
    both = cells.select(F.explode(F.array("actual", "predicted")).alias("label"))
    return [row[0] for row in both.where(F.col("label").isNotNull()).distinct().orderBy("label").collect()]


def confusion_matrix(cells: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Rows actual, columns predicted, over all labels of the cells or the given ones; 0 where nothing fell."""
    labels = confusion_labels(cells) if labels is None else list(labels)
    names = cells.sparkSession.createDataFrame([(name,) for name in labels], "actual string")
    wide = cells.groupBy("actual").pivot("predicted", list(labels)).agg(F.sum("n"))
    return names.join(wide, "actual", "left").na.fill(0, list(labels))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _with_rates(counted: DataFrame) -> DataFrame:
    rates = counted.withColumns(
        {
            "precision": _ratio(F.col("hits"), F.col("n_predicted")),
            "recall": _ratio(F.col("hits"), F.col("support")),
        }
    )
    both = F.col("precision") + F.col("recall")
    return rates.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))


def class_report(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, f1 and support of every label seen as actual or predicted."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = F.explode(
        F.array(
            F.struct(F.col("actual").alias("label"), hit.alias("hits"), F.col("n").alias("support"), none.alias("n_predicted")),
            F.struct(F.col("predicted").alias("label"), none.alias("hits"), none.alias("support"), F.col("n").alias("n_predicted")),
        )
    ).alias("__side")
    counted = (
        cells.select(*keys, sides)
        .select(*keys, "__side.*")
        .groupBy(*keys, "label")
        .agg(*[F.sum(name).alias(name) for name in ("hits", "support", "n_predicted")])
    )
    return _with_rates(counted)


def report_averages(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, plain means and support-weighted means of a class report."""
    measures = []
    for name in ("precision", "recall", "f1"):
        measures.append(F.avg(name).alias(f"macro_{name}"))
        measures.append(_ratio(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(f"weighted_{name}"))
    return report.groupBy(*keys).agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *measures,
        F.sum("support").alias("support"),
    )


def log_loss(
    df: DataFrame,
    actual: str,
    keys: Sequence[str] = (),
    probabilities: str = "probability",
    classes: str = "classes",
) -> DataFrame:
    """Mean log loss over rows whose actual class is a class, and how many rows hit the clip."""
    chance = P.probability_of(F.col(probabilities), F.col(classes), F.col(actual))
    return (
        df.withColumn("__chance", chance)
        .where(F.col("__chance").isNotNull())
        .groupBy(*keys)
        .agg(
            F.avg(P.log_loss_term(F.col("__chance"))).alias("log_loss"),
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("__chance") <= 0, 1).otherwise(0)), F.lit(0)).alias("n_clipped"),
        )
    )


def probability_patterns(df: DataFrame, keys: Sequence[str] = (), probabilities: str = "probability") -> DataFrame:
    """Distinct probability rows against rows: is the model saying the same thing every time?"""
    patterns = df.groupBy(*keys, F.col(probabilities).alias("__pattern")).agg(F.count(F.lit(1)).alias("__n"))
    return patterns.groupBy(*keys).agg(
        F.sum("__n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_patterns"),
        (F.count(F.lit(1)) == 1).alias("all_identical"),
    )


def probability_diagnostics(
    df: DataFrame, row_key: Sequence[str], available: Column, probabilities: str = "probability"
) -> DataFrame:
    """Row sum, number of positive entries and the available actors, per row."""
    return df.select(
        *row_key,
        P.total(F.col(probabilities)).alias("row_sum"),
        P.positive_count(F.col(probabilities)).alias("n_positive"),
        F.array_sort(F.array_compact(available)).alias("available"),
    )


def list_probabilities(df: DataFrame, row_key: Sequence[str], probabilities: str = "probability", classes: str = "classes") -> DataFrame:
    """One row per (row, class)."""
    pairs = F.arrays_zip(F.col(classes).alias("class"), F.col(probabilities).alias("p"))
    return df.select(*row_key, F.posexplode(pairs).alias("class_index", "__pair")).select(
        *row_key, "class_index", "__pair.class", "__pair.p"
    )
