"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.llm import textbytes as T
from rallyframe.llm.decontaminate import words_of
from rallyframe.llm.inputs import documents, result_schema, unpacked
from rallyframe.llm.samples import labelled_rows, labelled_sample, platt_of, precise_thresholds, sigmoid
from rallyframe.session import settle

#: A word's embedding is the rows of two tables at two hashes of it, so that two words seldom share both, and the sum
#: of a third table's rows at hashes of its beginnings, so that inflected and unseen forms have one too.
TABLE_BITS, PART = (18, 18, 20), 4
BEGINNINGS = (4, 5, 6, 7, 8)
WIDTHS, FILTERS = (1, 2, 3), 12
#: Rows and bytes of text that one part of the labelled rows has at most, on average; each part trains in a task.
PART_ROWS, PART_BYTES = 8000, 32 << 20
#: Rows of the tables that travel together when the parts' tables are averaged.
RANGE_ROWS = 1 << 15
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.02, 1e-4
#: Precision that a language's threshold aims at, and labelled rows that it needs to have one of its own.
PRECISION, LANGUAGE_ROWS = 0.95, 50
RESULTS = ["doc_id", "score", "lang_threshold", "toxic"]
WIDEST = max(WIDTHS)


#: Columns of `hashed` by table.
COLUMNS = ((0,), (1,), tuple(range(2, 2 + len(BEGINNINGS))))
#: Where each table starts, and the end of the last, when their places are numbered through.
STARTS = tuple(sum(1 << bits for bits in TABLE_BITS[:k]) for k in range(len(TABLE_BITS) + 1))


def described(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint and first eight bytes of every word, row bounds)."""
    prints, starts, ends, rows = words_of(data, bounds)
    size = np.minimum(ends - starts, 8).astype(np.uint64)
    head = T.lanes(T.LOWER[data])[starts]
    cut = (np.uint64(1) << (np.minimum(size, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
    return np.stack((prints, np.where(size < 8, head & cut, head)), axis=1), rows


def hashed(words: np.ndarray) -> np.ndarray:
    """The places of words in the tables; place 0 of each is the padding between texts and for missing beginnings."""
    out = np.zeros((len(words), 2 + len(BEGINNINGS)), np.int32)
    prints, head = words[:, 0], words[:, 1]
    out[:, 0] = prints % np.uint64((1 << TABLE_BITS[0]) - 1) + np.uint64(1)
    out[:, 1] = (prints >> np.uint64(32)) % np.uint64((1 << TABLE_BITS[1]) - 1) + np.uint64(1)
    for k, size in enumerate(BEGINNINGS):
        long = (head >> np.uint64(8 * (size - 1))) > 0
        part = head if size == 8 else head & np.uint64((1 << (8 * size)) - 1)
        place = T.mixed(part * T.STEP + np.uint64(size)) % np.uint64((1 << TABLE_BITS[2]) - 1) + np.uint64(1)
        out[:, 2 + k] = np.where(long, place, 0)
    return out


def padded(places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' words with WIDEST - 1 paddings after each and one word at least; the bounds of the rows."""
    sizes = np.diff(bounds)
    room = np.maximum(sizes, 1) + WIDEST - 1
    ends = np.cumsum(room)
    out = np.zeros((int(ends[-1]) if len(ends) else 0, places.shape[1]), np.int32)
    out[T.ragged(ends - room, sizes)] = places[T.ragged(bounds[:-1], sizes)]
    return out, np.concatenate(([0], ends))


@dataclass
class ConvModel:
    """Embedding tables, filters by width, output weights, calibration, and thresholds by language."""

    tables: list[np.ndarray]
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    shift: float
    slope: float = 1.0
    level: float = 0.0
    threshold: float = 0.5
    by_language: dict[str, float] = field(default_factory=dict)

    def embed(self, places: np.ndarray) -> np.ndarray:
        parts = []
        for table, columns in zip(self.tables, COLUMNS):
            part = table[places[:, columns[0]]]
            for k in columns[1:]:
                part += table[places[:, k]]
            parts.append(part)
        return np.concatenate(parts, axis=1)

    def pooled(self, places: np.ndarray, bounds: np.ndarray, where: bool = False):
        """Largest response of every filter in each row, at least 0; with `where` also the words it begins at.

        Only windows that end within their row count, so that a row's words alone decide.
        """
        x = self.embed(places)
        out, spots = [], []
        for width, weights, bias in zip(WIDTHS, self.filters, self.biases):
            n = len(x) - width + 1
            y = np.zeros((len(x), FILTERS), np.float32) + bias
            for k in range(width):
                y[:n] += x[k : k + n] @ weights[k]
            for k in range(1, width):
                y[bounds[1:] - k] = -np.inf
            best = np.maximum.reduceat(y, bounds[:-1], axis=0)
            out.append(np.maximum(best, 0))
            if where:
                spots.append(
                    np.stack([a + y[a:b].argmax(axis=0) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
                )
        return (np.concatenate(out, axis=1), spots) if where else np.concatenate(out, axis=1)

    def raw(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.pooled(places, bounds) @ self.output + self.shift

    def scores(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.raw(places, bounds).astype(np.float64) + self.level)


def _initial(seen: np.ndarray, bad: np.ndarray, toxic: float, rng: np.random.Generator) -> ConvModel:
    """Tables that start from the smoothed log odds of the rows that have a place; words never seen stay at zero.

    `seen` and `bad` count rows and toxic rows by place, one table after the other.
    """
    tables = []
    toxic = max(toxic, 1e-6)
    for bits, columns, start in zip(TABLE_BITS, COLUMNS, STARTS):
        n, hits = seen[start : start + (1 << bits)], bad[start : start + (1 << bits)]
        odds = np.log((hits + 5 * toxic) / (n - hits + 5 * (1 - toxic))) - np.log(toxic / (1 - toxic))
        table = np.zeros((1 << bits, PART), np.float32)
        table[:, 0] = np.where(n > 0, odds, 0) / len(columns)
        table[0] = 0
        tables.append(table)
    filters = [rng.normal(0, 0.2, (w, len(COLUMNS) * PART, FILTERS)).astype(np.float32) for w in WIDTHS]
    for weights in filters:
        weights[0, ::PART, : FILTERS // 2] = 0.5
    biases = [np.full(FILTERS, -0.1, np.float32) for _ in WIDTHS]
    output = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    return ConvModel(tables, filters, biases, output, float(np.log(toxic / (1 - toxic))))


def _train(model: ConvModel, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
    """Mini-batch steps with a rate for every weight (squared slopes summed up); toxic rows weigh as much as others."""
    weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    past: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, slope: np.ndarray, rows=None) -> None:
        total = past.setdefault(name, np.full(value.shape, 1e-2, np.float32))
        if rows is None:
            slope = slope + DECAY * value
            total += slope * slope
            value -= RATE * slope / np.sqrt(total)
        else:
            total[rows] += slope * slope
            value[rows] -= RATE * (slope + DECAY * value[rows]) / np.sqrt(total[rows])

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            own = order[begin : begin + BATCH]
            sizes = [len(texts[k]) for k in own]
            places, bounds = padded(np.concatenate([texts[k] for k in own]), np.concatenate(([0], np.cumsum(sizes))))
            pooled, spots = model.pooled(places, bounds, where=True)
            pull = (sigmoid(pooled @ model.output + model.shift) - labels[own]) * weight[own] / len(own)
            back = (pull[:, None] * model.output * (pooled > 0)).astype(np.float32)
            step("output", model.output, (pull @ pooled).astype(np.float32))
            model.shift -= RATE * float(pull.sum())
            touched, slopes = [], []
            for k, width in enumerate(WIDTHS):
                at = spots[k]
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                change = np.zeros_like(model.filters[k])
                for offset in range(width):
                    word = places[np.minimum(at + offset, len(places) - 1).reshape(-1)]  # the end is padding
                    x = model.embed(word).reshape(*at.shape, -1)
                    change[offset] = np.einsum("rf,rfe->ef", part, x)
                    touched.append(word)
                    slopes.append((part[:, :, None] * model.filters[k][offset].T[None]).reshape(-1, len(COLUMNS) * PART))
                step(f"filter{k}", model.filters[k], change)
                step(f"bias{k}", model.biases[k], part.sum(axis=0))
            spot, slope = np.concatenate(touched), np.concatenate(slopes)
            for k, columns in enumerate(COLUMNS):
                rows, inverse = np.unique(spot[:, columns], return_inverse=True)
                total = np.zeros((len(rows), PART), np.float32)
                own_slope = slope[:, k * PART : (k + 1) * PART]
                np.add.at(total, inverse.reshape(-1), np.repeat(own_slope, len(columns), axis=0))
                total[rows == 0] = 0  # padding stays zero
                step(f"table{k}", model.tables[k], total, rows)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and toxic rows that have a place, summed up over a partition."""
    seen, bad = np.zeros(STARTS[-1]), np.zeros(STARTS[-1])
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for first, end, data, bounds in T.slices(batch.column("text")):
            words, rows = described(data, bounds)
            places = hashed(words)
            for label, a, b in zip(labels[first:end], rows[:-1], rows[1:]):
                for columns, start in zip(COLUMNS, STARTS):
                    own = np.unique(places[a:b, columns]) + start
                    seen[own] += 1
                    bad[own] += label
    found = np.flatnonzero(seen)
    for part in np.array_split(found, len(found) // RANGE_ROWS + 1):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(seen[part]), pa.array(bad[part])], names=["place", "seen", "bad"]
        )


def _dense(model: ConvModel) -> np.ndarray:
    """All weights outside the tables, one after the other."""
    return np.concatenate([*(x.reshape(-1) for x in (*model.filters, *model.biases, model.output)), [model.shift]])


def _set_dense(model: ConvModel, values: np.ndarray) -> None:
    at = 0
    for weights in (*model.filters, *model.biases, model.output):
        weights[...] = values[at : at + weights.size].reshape(weights.shape)
        at += weights.size
    model.shift = float(values[at])


SUMS = "range int, weight double, places binary, weights binary"


def _trained(start: ConvModel, rng: np.random.Generator):
    """A function that trains `start` on the rows of one part and gives what differs then, by range of places.

    The range -1 holds the weights outside the tables.
    """

    def train(part: pa.Table) -> pa.Table:
        rows = []
        labels, langs = part["label"].to_pylist(), part["lang"].to_pylist()
        for first, end, data, bounds in T.slices(part["text"]):
            words, ends = described(data, bounds)
            for k, a, b in zip(range(first, end), ends[:-1], ends[1:]):
                rows.append((zlib.crc32(words[a:b].astype("<u8").tobytes()), labels[k], langs[k] or "", hashed(words[a:b])))
        rows.sort(key=lambda r: r[:3])  # the order of stored partitions says nothing
        model = copy.deepcopy(start)
        _train(model, [r[3] for r in rows], np.array([r[1] for r in rows], np.float64), copy.deepcopy(rng))
        out = [(-1, float(len(rows)), b"", _dense(model).astype("<f8").tobytes())]
        for old, table, offset in zip(start.tables, model.tables, STARTS):
            changed = np.flatnonzero((old != table).any(axis=1))
            cuts = np.flatnonzero(np.diff((changed + offset) // RANGE_ROWS)) + 1
            for own in np.split(changed, cuts):
                if len(own):
                    places = (own + offset).astype("<i4")
                    number = int(places[0]) // RANGE_ROWS
                    out.append((number, float(len(rows)), places.tobytes(), table[own].astype("<f4").tobytes()))
        columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.float64(), pa.binary(), pa.binary()))]
        return pa.Table.from_arrays(columns, names=["range", "weight", "places", "weights"])

    return train


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of every weight over the parts that changed it, a part counting by its rows."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for number, weight, places, weights in zip(*(x.to_pylist() for x in batch.columns)):
            if number < 0:
                values = np.frombuffer(weights, "<f8")[:, None]
                at = np.arange(len(values))
            else:
                values = np.frombuffer(weights, "<f4").reshape(-1, PART)
                at = np.frombuffer(places, "<i4") - number * RANGE_ROWS
            if number not in sums:
                size = len(values) if number < 0 else RANGE_ROWS
                sums[number] = [np.zeros((size, values.shape[1])), np.zeros(size)]
            sums[number][0][at] += weight * values
            sums[number][1][at] += weight
    for number, (total, weight) in sums.items():
        at = np.flatnonzero(weight)
        mean = total[at] / weight[at][:, None]
        places = (at + max(number, 0) * RANGE_ROWS).astype("<i4").tobytes()
        kind = "<f8" if number < 0 else "<f4"
        row = ([number], [float(weight.max())], [places], [mean.astype(kind).tobytes()])
        columns = [pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.float64(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["range", "weight", "places", "weights"])


def _fit(rows: DataFrame, parts: int, toxic: float, seed: int) -> ConvModel:
    """A model of all of `rows`: odds counted over all of them, then every part of them trains and the parts are averaged.

    The driver gets counts and weights by place, whose number is fixed.
    """
    seen, bad = np.zeros(STARTS[-1]), np.zeros(STARTS[-1])
    counted = rows.select("text", "label").mapInArrow(_counts, "place int, seen double, bad double")
    table = counted.groupBy("place").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).toArrow()
    places = table["place"].to_numpy()
    seen[places], bad[places] = table["seen"].to_numpy(), table["bad"].to_numpy()
    rng = np.random.default_rng(seed)
    model = _initial(seen, bad, toxic, rng)
    part = F.pmod("place", F.lit(parts)).cast("int").alias("part")
    dealt = rows.select("text", "label", "lang", part).repartition(parts, "part")
    changes = dealt.groupBy("part").applyInArrow(_trained(model, rng), SUMS)
    for number, _, places, weights in settle(changes.repartition("range").mapInArrow(_averaged, SUMS)).toLocalIterator():
        if number < 0:
            _set_dense(model, np.frombuffer(weights, "<f8"))
            continue
        places = np.frombuffer(places, "<i4")
        k = int(np.searchsorted(STARTS, places[0], side="right")) - 1
        model.tables[k][places - STARTS[k]] = np.frombuffer(weights, "<f4").reshape(-1, PART)
    return model


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, where: Column | None = None, sample_rows: int | None = None, seed: int = 7
) -> ConvModel:
    """A model of `labels.toxic` from all rows that `where` lets through, whole texts of any length.

    Four folds train it; on the fifth its scores are calibrated and a threshold is set for every language with enough
    rows, and one for the others. Language decides thresholds only, never a score. With labels of one kind or none,
    every text gets the share of toxic ones as its score (a half if there is no label).

    The training rows are dealt into parts of about `PART_ROWS` rows (and `PART_BYTES`), each trained in a task of its
    own from the same start; the model is their mean, for a table's row over the parts that changed it. Calibration and
    thresholds come from sums over all rows of the fifth fold. With `sample_rows`, a sample of so many rows stands for
    all of them.
    """
    lang = (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang")
    if sample_rows is None:
        chosen = labelled_rows(docs, labels, "toxic", where, more=(lang,))
    else:
        chosen = labelled_sample(docs, labels, "toxic", sample_rows, None, where, more=(lang,))
    # copies of one id are dealt by their texts as well, so that only equal rows need share a part
    rows = settle(chosen.select("text", "label", "fold", "lang", F.xxhash64("doc_id", "text").alias("place")))
    label = F.col("label")
    sizes = [F.count("*"), F.sum(label), F.min(label), F.max(label), F.sum(F.octet_length("text"))]
    folds = {r[0]: tuple(r[1:]) for r in rows.groupBy("fold").agg(*sizes).collect()}

    def total(cells: list[tuple]) -> tuple:
        n, hits, least, most, size = zip(*cells)
        return sum(n), sum(hits), min(least), max(most), sum(size)

    n, hits, least, most, size = total(list(folds.values())) if folds else (0, 0, 0, 0, 0)
    if least == most:
        model = _initial(*np.zeros((2, STARTS[-1])), (hits + 0.5) / (n + 1), np.random.default_rng(seed))
        model.output[:] = 0
        return model
    others = [cell for fold, cell in folds.items() if fold != 0]
    fitting = held = rows
    if 0 in folds and others and total(others)[2] < total(others)[3]:
        fitting, held = rows.where("fold != 0"), rows.where("fold = 0")
        n, hits, _, _, size = total(others)
    parts = max(math.ceil(n / PART_ROWS), math.ceil(size / PART_BYTES), 1)
    model = _fit(fitting, parts, hits / n, seed)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in T.slices(batch.column("text"), 1 << 19):
                words, ends = described(data, bounds)
                raw = model.raw(*padded(hashed(words), ends)).astype(np.float64)
                kept = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(raw), kept.column("label"), kept.column("lang")], names=["raw", "label", "lang"]
                )

    raw = settle(held.select("text", "label", "lang").mapInArrow(scored, "raw double, label int, lang string"))
    model.slope, model.level = platt_of(raw)
    score = 1 / (1 + F.exp(-(F.least(F.greatest(model.slope * F.col("raw") + model.level, F.lit(-40.0)), F.lit(40.0)))))
    names = F.array_distinct(F.array(F.lit(""), F.coalesce("lang", F.lit(""))))
    limits = precise_thresholds(raw.select(F.explode(names).alias("name"), score.alias("score"), "label"), PRECISION)
    for name, rows_, good, threshold in limits.collect():
        if name == "":
            model.threshold = threshold
        elif rows_ >= LANGUAGE_ROWS and good:
            model.by_language[name] = threshold
    return model


def toxicity(docs: DataFrame, model: ConvModel, carry: Iterable[str] = ()) -> DataFrame:
    """doc_id, score (0 to 1), lang_threshold and toxic (score at least that threshold) of every document.

    A score depends on the words of the whole text alone: runs of letters, digits and bytes beyond ASCII, A-Z lowered.
    Null and empty texts are one padding word. Without a column `lang`, or with an unknown or null language, the
    threshold of all languages holds. Repeated rows stay; an empty table gives an empty result.
    """
    carry = list(carry)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    source = documents(docs.withColumn("lang", lang), [*carry, *(["lang"] if "lang" not in carry else [])], RESULTS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in T.slices(batch.column("text"), 1 << 19):
                words, rows = described(data, bounds)
                scores = model.scores(*padded(hashed(words), rows))
                kept = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [kept.column("doc_id"), pa.array(scores), kept.column("carried")],
                    names=["doc_id", "score", "carried"],
                )

    rows = source.mapInArrow(score, result_schema(source, "score double"))
    threshold = F.lit(model.threshold)
    for language, value in model.by_language.items():
        threshold = F.when(F.col("carried.lang") == language, F.lit(value)).otherwise(threshold)
    judged = rows.withColumn("lang_threshold", threshold)
    judged = judged.withColumn("toxic", F.col("score") >= F.col("lang_threshold"))
    out = unpacked(judged.select(*RESULTS, "carried"))
    return out if "lang" in carry else out.drop("lang")
