"""Quality rules: exact counts of each text and a logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm import textbytes as T
from rallyframe.llm.inputs import documents, result_schema, unpacked
from rallyframe.llm.samples import gathered, give_back, labelled_sample, platt, sigmoid

#: Buckets of each family of n-grams: words, pairs of words, three characters, five characters.
FAMILY_BITS, FAMILIES = 16, 4
SIZE = FAMILIES << FAMILY_BITS
#: Rows that a model is fitted on, at most, and bytes of a text among them.
SAMPLE_ROWS, SAMPLE_DOC_BYTES = 3000, 1 << 16
ROUNDS, RATE, DECAY = 60, 0.3, 1e-4
#: Sample rows that a step of the fit has in hand.
BLOCK_ROWS = 250
RESULTS = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality",
]
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])


def repeat_words(prints: np.ndarray, words: np.ndarray, window: int = 5) -> np.ndarray:
    """Words of each row in windows that the row has twice or more."""
    starts, row = T.window_starts(words, window)
    if not len(starts):
        return np.zeros(len(words) - 1, np.int64)
    own = T.mixed(T.window_prints(prints, window)[starts] + row.astype(np.uint64) * T.SECOND)
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), np.bool_)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return _per_row(T.covered(starts[twice], window, len(prints)), words)


def duplicate_lines(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Lines of each row with a word that equal an earlier line of the row."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate((bounds[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    row = np.searchsorted(bounds, starts, side="right") - 1
    stops = np.append(breaks, len(data))
    ends = np.minimum(stops[np.searchsorted(stops, starts)], bounds[row + 1])
    seen = np.concatenate(([0], np.cumsum(T.NOT_SPACE[data])))
    full = seen[ends] > seen[starts]
    starts, ends, row = starts[full], ends[full], row[full]
    own = T.mixed(T.span_prints(data, starts, ends) + row.astype(np.uint64) * T.SECOND)
    _, first = np.unique(own, return_index=True)
    again = np.ones(len(own), np.bool_)
    again[first] = False
    return np.bincount(row[again], minlength=len(bounds) - 1)


def ngrams(data: np.ndarray, bounds: np.ndarray, prints: np.ndarray, words: np.ndarray):
    """For each family: (bucket of each n-gram, row bounds among them)."""
    shift = np.uint64(64 - FAMILY_BITS)
    out = [((prints >> shift).astype(np.int64), words)]
    starts, _ = T.window_starts(words, 2)
    counts = np.maximum(np.diff(words) - 1, 0)
    out.append(((T.window_prints(prints, 2)[starts] >> shift).astype(np.int64), np.concatenate(([0], np.cumsum(counts)))))
    eight = T.lanes(data)[: len(data)]
    for size in (3, 5):
        grams = eight & np.uint64((1 << (8 * size)) - 1)
        bucket = ((grams * T.LANE) >> shift).astype(np.int64)
        counts = np.maximum(np.diff(bounds) - size + 1, 0)
        if len(data):
            crossing = np.ones(len(data), np.bool_)
            for k in range(1, size):
                at = bounds[1:] - k
                crossing[at[at >= bounds[:-1]]] = False
            bucket = bucket[crossing]
        out.append((bucket, np.concatenate(([0], np.cumsum(counts)))))
    return out


@dataclass
class QualityModel:
    """Weights by family and bucket, their shift, and the calibration of the sum."""

    weights: np.ndarray
    shift: float
    slope: float
    level: float

    def probabilities(self, families) -> np.ndarray:
        rows = len(families[0][1]) - 1
        total = np.full(rows, self.shift)
        for weights, (bucket, bounds) in zip(self.weights, families):
            sums = np.concatenate(([0.0], np.cumsum(weights[bucket], dtype=np.float64)))
            total += np.diff(sums[bounds]) / np.maximum(np.diff(bounds), 1)
        return sigmoid(self.slope * total + self.level)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of sample rows: family * buckets + bucket, and the share in the family."""
    for batch in batches:
        for first, end, data, bounds in T.slices(batch.column("text"), 1 << 18):
            starts, ends, words = T.word_spans(data, bounds, T.NOT_SPACE)
            families = ngrams(data, bounds, T.span_prints(data, starts, ends), words)
            places, shares = [], []
            for k in range(end - first):
                place, share = [], []
                for family, (bucket, own) in enumerate(families):
                    used, counts = np.unique(bucket[own[k] : own[k + 1]], return_counts=True)
                    place.append(used + (family << FAMILY_BITS))
                    share.append(counts / max(1, counts.sum()))
                places.append(np.concatenate(place).astype("<i4").tobytes())
                shares.append(np.concatenate(share).astype("<f4").tobytes())
            kept = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays(
                [kept.column("label"), kept.column("fold"), pa.array(places), pa.array(shares)],
                names=["label", "fold", "places", "shares"],
            )


@dataclass
class _Block:
    """Sparse features of a few sample rows: bucket and share of each n-gram, and where each row's begin."""

    places: np.ndarray
    shares: np.ndarray
    heads: np.ndarray
    labels: np.ndarray

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of every row; every row has a last entry of share 0."""
        return np.add.reduceat(weights[self.places] * self.shares, self.heads)

    def back(self, values: np.ndarray) -> np.ndarray:
        """The sum over rows of value times share, by bucket."""
        counts = np.diff(np.append(self.heads, len(self.places)))
        return np.bincount(self.places, weights=np.repeat(values, counts) * self.shares, minlength=SIZE)


def _blocks(rows: Iterator) -> tuple[list[_Block], list[_Block]]:
    """The rows to fit on and those to calibrate on, in blocks."""
    done: tuple[list[_Block], list[_Block]] = ([], [])
    parts: tuple[list, list] = ([], [])

    def close(side: int) -> None:
        if part := parts[side]:
            counts = np.array([len(p) for p, _, _ in part])
            done[side].append(
                _Block(
                    np.concatenate([p for p, _, _ in part]),
                    np.concatenate([s for _, s, _ in part]),
                    np.cumsum(counts) - counts,
                    np.array([y for _, _, y in part], np.float64),
                )
            )
            part.clear()

    for row in rows:
        side = int(row["fold"] == 0)
        places = np.append(np.frombuffer(row["places"], "<i4"), np.int32(0))
        shares = np.append(np.frombuffer(row["shares"], "<f4"), np.float32(0))
        parts[side].append((places, shares, row["label"]))
        if len(parts[side]) == BLOCK_ROWS:
            close(side)
    close(0)
    close(1)
    return done


def _fit(blocks: list[_Block], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch steps with their own rate for each weight, a block of rows at a time."""
    weights, shift = np.zeros(SIZE), 0.0
    good, bad = (0.5 / max(part, 1e-6) / len(labels) for part in (labels.mean(), 1 - labels.mean()))
    # rare buckets are damped: their spread over the rows stays small, that of common ones is brought to one
    spread = sum(np.bincount(b.places, weights=b.shares * b.shares, minlength=SIZE) for b in blocks)
    spread = np.sqrt(spread / len(labels)) + 0.01
    first, second = np.zeros(SIZE), np.zeros(SIZE)
    for k in range(1, ROUNDS + 1):
        slope, change = DECAY * weights, 0.0
        scaled = (weights / spread).astype(np.float32)
        for block in blocks:
            pull = (sigmoid(block.sums(scaled) + shift) - block.labels) * np.where(block.labels > 0, good, bad)
            slope += block.back(pull) / spread
            change += pull.sum()
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        weights -= RATE * 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-4)
        shift -= RATE * change
    return weights / spread, shift


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """A model of `labels.quality`, from at most `sample_rows` rows; four folds fit it, the fifth calibrates it.

    With labels of one kind or none, every document gets the share of good ones (a half if there is no label).
    """
    sample = labelled_sample(docs, labels, "quality", sample_rows, SAMPLE_DOC_BYTES)
    features = sample.mapInArrow(_features, "label int, fold int, places binary, shares binary")
    model = _learned(*_blocks(gathered(features, 2 * sample_rows)))
    give_back()
    return model


def _learned(fitting: list[_Block], held: list[_Block]) -> QualityModel:
    """The model of the rows in `fitting`, calibrated on those in `held`."""
    y = np.concatenate([np.empty(0), *(b.labels for b in fitting + held)])
    if not len(y) or y.min() == y.max():
        part = (y.sum() + 0.5) / (len(y) + 1)
        return QualityModel(np.zeros((FAMILIES, 1 << FAMILY_BITS), np.float32), 0.0, 1.0, float(np.log(part / (1 - part))))
    own = np.concatenate([np.empty(0), *(b.labels for b in fitting)])
    if not len(own) or own.min() == own.max() or not held:
        fitting = held = fitting + held
        own = y
    weights, shift = _fit(fitting, own)
    raw = np.concatenate([b.sums(weights) for b in held]) + shift
    slope, level = platt(raw, np.concatenate([b.labels for b in held]))
    return QualityModel(weights.reshape(FAMILIES, -1).astype(np.float32), shift, slope, level)


def quality_rules(docs: DataFrame, model: QualityModel, threshold: float = 0.5, carry: Iterable[str] = ()) -> DataFrame:
    """doc_id, the counts of each text, base_failed, kept and quality (the calibrated probability).

    Words lie between ASCII white space. base_failed: fewer than 10 words, or over 20 in 100 of them in windows of five
    words that the text has twice or more. kept: not base_failed, and quality at least `threshold`.

    Null text has no words and fails. Repeated rows stay; an empty table gives an empty result.
    """
    source = documents(docs, carry, RESULTS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in T.slices(batch.column("text"), 1 << 18):
                starts, ends, words = T.word_spans(data, bounds, T.NOT_SPACE)
                prints = T.span_prints(data, starts, ends)
                chars = T.NOT_SPACE[data] & ((data & 0xC0) != 0x80)
                columns = [
                    np.diff(words),
                    _per_row(chars, bounds),
                    _per_row(SYMBOLS[data], bounds),
                    duplicate_lines(data, bounds),
                    repeat_words(prints, words),
                    model.probabilities(ngrams(data, bounds, prints, words)),
                ]
                kept = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [kept.column("doc_id"), *map(pa.array, columns), *kept.columns[2:]],
                    names=["doc_id", *RESULTS[1:6], "quality", *kept.schema.names[2:]],
                )

    kept = ["carried"] if "carried" in source.columns else []
    counts = ", ".join(f"{x} long" for x in RESULTS[1:6])
    rows = source.mapInArrow(score, result_schema(source, f"{counts}, quality double"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))
    return unpacked(judged.select(*RESULTS, *kept))
