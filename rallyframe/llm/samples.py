"""Labelled documents to fit classifiers on, all or bounded samples, and calibration of their scores."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from rallyframe.llm.inputs import ship
from rallyframe.session import settle


#: Ranges of scores within which thresholds are looked for one beside the other.
SCORE_RANGES = 256


def _usable(labels: DataFrame, label: str, where: Column | None) -> DataFrame:
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull()
    )
    return usable if where is None else usable.filter(where)


def _texts(docs: DataFrame, more: tuple[Column, ...]) -> DataFrame:
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text")
    return docs.select("doc_id", text, *more)


def _fold() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).cast("int").alias("fold")


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None, more: tuple[Column, ...] = ()
) -> DataFrame:
    """doc_id, text, label, `fold` (0 to 4) and `more` of all labelled documents. Null labels and ids are left out.

    Labels grow with the documents, so at no size are they sent to every task.
    """
    texts = _texts(docs, more)
    return texts.join(_usable(labels, label, where).hint("merge"), "doc_id").select(*texts.columns, "label", _fold())


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    rows: int,
    doc_bytes: int | None,
    where: Column | None = None,
    more: tuple[Column, ...] = (),
) -> DataFrame:
    """doc_id, text, label, `fold` (0 to 4) and `more` of at most `rows` labelled documents of at most `doc_bytes` bytes.

    The rows with the least hashes of their id are taken, so that the sample is random and the same in every run. Null
    labels and ids are left out. Without `doc_bytes`, texts may have any length.
    """
    # at most `rows` short rows, so they may be sent to every task
    chosen = _usable(labels, label, where).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = _texts(docs, more)
    if doc_bytes is not None:
        texts = texts.filter(F.octet_length("text") <= doc_bytes)
    return texts.join(F.broadcast(chosen), "doc_id").select(*texts.columns, "label", _fold())


def gathered(sample: DataFrame, rows: int) -> Iterator[Row]:
    """At most `rows` rows, one stored partition after the other, so that the driver holds no second copy."""
    return islice(settle(sample).toLocalIterator(), rows)


def give_back() -> None:
    """What a fit has freed in the driver's Python goes back to the system, if its C library can do that."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(scores: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through raw scores, fitted to smoothed labels by Newton steps."""
    high, low = labels.sum(), (1 - labels).sum()
    if not high or not low:
        return 1.0, 0.0
    goal = np.where(labels > 0, (high + 1) / (high + 2), 1 / (low + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * scores + b)
        g = np.array([((p - goal) * scores).sum(), (p - goal).sum()])
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * scores * scores).sum(), (w * scores).sum()], [(w * scores).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def platt_of(rows: DataFrame, rounds: int = 50) -> tuple[float, float]:
    """`platt` over columns `raw` and `label` of any number of rows: every Newton step is one sum over them."""
    label = F.col("label")
    high, low = rows.agg(F.sum(label), F.sum(1 - label)).first()
    if not high or not low:
        return 1.0, 0.0
    goal = F.when(label > 0, F.lit((high + 1) / (high + 2))).otherwise(F.lit(1 / (low + 2)))
    raw = F.col("raw")
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.least(F.greatest(a * raw + b, F.lit(-40.0)), F.lit(40.0))))
        parts = rows.select(raw, (p - goal).alias("off"), (p * (1 - p) + 1e-6).alias("w"))
        off, w = F.col("off"), F.col("w")
        ga, gb, aa, ab, bb = parts.agg(F.sum(off * raw), F.sum(off), F.sum(w * raw * raw), F.sum(w * raw), F.sum(w)).first()
        step = np.linalg.solve(np.array([[aa, ab], [ab, bb]]) + 1e-6 * np.eye(2), np.array([ga, gb]))
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def precise_thresholds(rows: DataFrame, precision: float) -> DataFrame:
    """name, n, hits and threshold: the least score from which on at least `precision` of a name's rows have label 1.

    `rows` has name, score and label; equal scores are decided alike; 0.5 where there is none. Scores are summed up by
    ranges of near equal size first, so that no task sees all of a name's.
    """
    marks = rows.approxQuantile("score", [k / SCORE_RANGES for k in range(1, SCORE_RANGES)], 1 / (4 * SCORE_RANGES))
    block = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(marks))]), lambda x: x <= F.col("score")))
    cells = settle(
        rows.groupBy("name", "score")
        .agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
        .withColumn("block", block)
    )
    above = Window.partitionBy("name").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("name", "block").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    before = blocks.select(
        "name", "block", *[F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"{x}_before") for x in ("n", "hits")]
    )
    within = Window.partitionBy("name", "block").orderBy(F.desc("score"))
    n = F.sum("n").over(within) + F.col("n_before")
    hits = F.sum("hits").over(within) + F.col("hits_before")
    judged = cells.join(before, ["name", "block"]).withColumn("good", hits >= precision * n)
    out = judged.groupBy("name").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min(F.when(F.col("good"), F.col("score"))).alias("least")
    )
    found = F.when(F.col("hits") > 0, F.coalesce("least", F.lit(0.5))).otherwise(F.lit(0.5))
    return out.select("name", "n", "hits", found.alias("threshold"))
