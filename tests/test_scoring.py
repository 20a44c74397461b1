"""Masking, predictability, reports and log loss on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rallyframe.functions import probability as P
from rallyframe.models.boosted import fit_boosted_model
from rallyframe.models.frequency import fit_frequency_model
from rallyframe.operators import evaluation as E
from rallyframe.operators import groups as G
from rallyframe.schema import EPSILON

CLASSES = ["-1", "-2", "-3"]
SCHEMA = (
    "id int, rotation int, quality double, actual string, on_court array<string>, "
    "probability array<double>, classes array<string>"
)


def scored(spark, rows):
    df = spark.createDataFrame([(*row, CLASSES) for row in rows], SCHEMA)
    masked = E.mask_to_available(df, CLASSES, F.col("on_court"))
    return E.add_predictability(masked, "actual", len(CLASSES))


@pytest.fixture(scope="module")
def frame(spark):
    return scored(
        spark,
        [
            (1, 1, 4.0, "-1", ["-1", "-3", None], [0.5, 0.3, 0.2]),
            (2, 1, 3.0, "-2", ["-9"], [0.5, 0.3, 0.2]),
            (3, 2, None, "-2", CLASSES, [0.4, 0.4, 0.2]),
            (4, None, 1.0, "-3", ["-1", "-2"], [0.1, 0.2, 0.7]),
        ],
    ).cache()


def test_masking_and_entropy(frame):
    rows = {row.id: row for row in frame.collect()}
    assert [round(p, 6) for p in rows[1].probability] == [0.714286, 0.0, 0.285714]
    assert round(rows[1].pred_entropy, 6) == 0.598270
    assert rows[1].top_predicted == "-1" and rows[1].prediction_correct
    assert rows[2].probability == [0.0, 0.0, 0.0]
    assert rows[2].pred_entropy == 0.0 and math.copysign(1, rows[2].pred_entropy) == 1
    assert rows[2].top_predicted == "-1" and rows[2].chose_non_top
    assert rows[3].top_predicted == "-1"
    assert rows[4].top_predicted == "-2"


def test_log_loss_clips_masked_classes(frame):
    got = E.log_loss(frame.where("id = 4"), "actual").first()
    assert round(got.log_loss, 6) == 36.043653 and got.n_clipped == 1
    both = E.log_loss(frame.where("id in (1, 4)"), "actual").first()
    assert both.log_loss == pytest.approx((-math.log(0.5 / 0.7) - math.log(EPSILON)) / 2)


def test_summary_separates_in_system_rows(frame):
    got = E.summarise(frame, F.col("quality") >= 3).first()
    assert got.overall_accuracy == 0.25
    assert got.insystem_accuracy == 0.5
    assert got.overall_accuracy + got.non_top_rate_all == 1
    listed = {row.metric: row.value for row in E.listed_metrics(E.summarise(frame, F.col("quality") >= 3)).collect()}
    assert listed["insystem_accuracy"] == 0.5 and len(listed) == 6


def test_rotations_without_rows_are_listed(frame):
    rows = {row.rotation: row for row in E.by_rotation(frame, "rotation", 1, 6).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    assert rows[4].mean_entropy is None and rows[4].non_top_rate is None
    assert rows[1].non_top_rate == 0.5


def test_rotations_by_period_are_listed(spark, frame):
    tagged = frame.withColumn("period", F.when(F.col("id") < 3, "pre").otherwise("conf1"))
    rows = E.by_rotation(tagged, "rotation", 1, 6, ["period"]).collect()
    assert len(rows) == 12
    wide = E.compare_periods(E.summarise(tagged, F.col("quality") >= 3, ["period"]), "period", ["pre", "conf1"])
    got = {row.metric: (row.pre, row.conf1) for row in wide.collect()}
    assert got["overall_accuracy"] == (0.5, 0.0)
    assert got["insystem_accuracy"] == (0.5, None)


def test_probability_properties(spark):
    rng = random.Random(5)
    rows = []
    for n in range(300):
        raw = [rng.random() for _ in CLASSES]
        on_court = [c for c in CLASSES if rng.random() < 0.6] + [None]
        rows.append((n, 1, 3.0, rng.choice(CLASSES), on_court, [p / sum(raw) for p in raw]))
    for row in scored(spark, rows).collect():
        total = sum(row.probability)
        available = [c for c in row.on_court if c]
        assert total == pytest.approx(1) if available else total == 0
        for name, p in zip(CLASSES, row.probability):
            assert name in available or p == 0
        assert -1e-12 <= row.pred_entropy <= math.log(max(len(available), 1)) + 1e-9
        assert row.prediction_correct != row.chose_non_top


def brute_report(pairs):
    out = {}
    for label in {x for pair in pairs for x in pair}:
        hits = sum(a == p == label for a, p in pairs)
        support = sum(a == label for a, _ in pairs)
        predicted = sum(p == label for _, p in pairs)
        precision = hits / predicted if predicted else 0.0
        recall = hits / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        out[label] = (precision, recall, f1, support)
    return out


def test_class_report_and_averages(spark):
    rng = random.Random(3)
    pairs = [(rng.choice("abc"), rng.choice("abd")) for _ in range(200)]
    cells = E.confusion_cells(spark.createDataFrame(pairs, "t string, p string"), "t", "p")
    report = E.class_report(cells)
    got = {row.label: (row.precision, row.recall, row.f1, row.support) for row in report.collect()}
    want = brute_report(pairs)
    assert got.keys() == want.keys()
    for label in want:
        assert got[label] == pytest.approx(want[label])
    assert got["d"] == (0.0, 0.0, 0.0, 0)
    averages = E.report_averages(report).first()
    assert averages.accuracy == pytest.approx(sum(a == p for a, p in pairs) / len(pairs))
    assert averages.macro_f1 == pytest.approx(sum(v[2] for v in want.values()) / len(want))
    assert averages.weighted_recall == pytest.approx(sum(v[1] * v[3] for v in want.values()) / len(pairs))


def test_confusion_matrix_covers_all_labels(spark):
    pairs = [("a", "b"), ("a", "b"), ("b", "b")]
    cells = E.confusion_cells(spark.createDataFrame(pairs, "t string, p string"), "t", "p")
    got = {row.actual: (row.a, row.b, row.c) for row in E.confusion_matrix(cells, ["a", "b", "c"]).collect()}
    assert got == {"a": (0, 2, 0), "b": (0, 1, 0), "c": (0, 0, 0)}


def test_patterns_and_diagnostics(spark, frame):
    got = E.probability_patterns(frame).first()
    assert (got.n_rows, got.n_patterns, got.all_identical) == (4, 4, False)
    same = scored(spark, [(n, 1, 3.0, "-1", CLASSES, [0.5, 0.3, 0.2]) for n in range(3)])
    assert E.probability_patterns(same).first().all_identical is True
    checks = {row.id: row for row in E.probability_diagnostics(frame, ["id"], F.col("on_court")).collect()}
    assert (checks[1].n_positive, round(checks[1].row_sum, 9), checks[1].available) == (2, 1.0, ["-1", "-3"])
    assert (checks[2].n_positive, checks[2].row_sum) == (0, 0.0)


def test_one_point_listing(frame):
    rows = E.list_probabilities(frame.where("id = 3"), ["id"]).orderBy("class_index").collect()
    assert [(row["class"], row.p) for row in rows] == [("-1", 0.4), ("-2", 0.4), ("-3", 0.2)]


def test_frequency_model(spark):
    train = spark.createDataFrame([("x", "b"), ("x", "b"), ("x", "a"), ("y", "c")], "k string, t string")
    model = fit_frequency_model(train, ["k"], "t")
    got = {row.k: row for row in model.transform(spark.createDataFrame([("x",), ("y",), ("z",)], "k string")).collect()}
    assert got["x"].classes == ["a", "b", "c"]
    assert got["x"].probability == pytest.approx([1 / 3, 2 / 3, 0])
    assert got["y"].probability == [0.0, 0.0, 1.0]
    assert got["z"].probability is None


def test_flag_rates_leave_nulls_out(spark):
    df = spark.createDataFrame([(True, None), (False, None), (None, True)], "a boolean, b boolean")
    got = {row.flag: (row.n, row.rate) for row in G.flag_rates(df, ["a", "b"]).collect()}
    assert got == {"a": (1, 0.5), "b": (1, 1.0)}


def test_boosted_model_learns_and_skips_absent_classes(spark):
    rng = random.Random(9)
    rows = [(float(n % 2), rng.random(), n % 2 * 2) for n in range(200)]
    train = spark.createDataFrame(rows, "x double, noise double, target int")
    model = fit_boosted_model(train, ["x", "noise"], "target", ["-1", "-2", "-3"], 3, 2, 0.1, 1.0, 42)
    assert model.members[1] is None
    got = model.transform(train).select("x", "probability", "classes").distinct().collect()
    for row in got:
        assert sum(row.probability) == pytest.approx(1)
        assert row.probability[1] == 0
        assert (row.probability[0] > 0.5) == (row.x == 0.0)
    importances = {row.feature: row.importance for row in model.importances(train).collect()}
    assert importances["x"] > importances["noise"]


def test_top_class_of_an_unknown_actual(spark):
    df = spark.createDataFrame([(CLASSES, [0.2, 0.3, 0.5], "-7")], "c array<string>, p array<double>, a string")
    row = df.select(P.top_class(F.col("p"), F.col("c")), P.probability_of(F.col("p"), F.col("c"), F.col("a"))).first()
    assert tuple(row) == ("-3", None)


def test_long_class_lists_give_the_same_numbers(spark, monkeypatch):
    rng = random.Random(8)
    rows = [
        (n, 1, 3.0, "-1", [c for c in CLASSES if rng.random() < 0.5] + [None], [rng.random() for _ in CLASSES])
        for n in range(100)
    ]
    written_out = sorted(map(str, scored(spark, rows).collect()))
    monkeypatch.setattr(P, "WRITTEN_OUT", 2)
    assert sorted(map(str, scored(spark, rows).collect())) == written_out
