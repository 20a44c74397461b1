"""Live scoring in any batch cut, updating over blocks, calibration summaries, sparse probabilities."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rallyframe.functions import sparse as S
from rallyframe.models.frequency import fit_frequency_model, fit_sparse_frequency_model
from rallyframe.operators import evaluation as E
from rallyframe.operators.calibration import (
    brier,
    calibration_error,
    confidence_cells,
    merged_cells,
    reliability,
)
from rallyframe.operators.ordered import Ordered, previous, recent
from rallyframe.operators.updating import add_counts_so_far, add_updated
from rallyframe.streaming import live_scoring

LINES = "game long, line long, actor string, good boolean, ts timestamp"
START = dt.datetime(2024, 5, 1, 12)


def coded(seed, n=160, games=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        at = START + dt.timedelta(seconds=5 * k, microseconds=rng.randrange(3) * 300)
        out.append((rng.randrange(games), k, rng.choice("abcde") if rng.random() > 0.05 else None, rng.random() < 0.7, at))
    return out


def batch_rows(frame):
    slot = F.when(F.col("good"), F.col("actor"))
    rows = Ordered.bounded(frame.withColumn("slot", slot).withColumn("there", F.lit(True)), ["game"], ["line"])
    found = rows.scan(before=previous("actor", "there"), last=recent(6, "slot")).df
    kept = found.select("game", "line", "actor", F.col("before.actor").alias("prev"), F.col("last.slot").alias("recent"))
    return sorted(map(tuple, kept.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("seed, cuts", [(1, 1), (2, 3), (3, 5)])
def test_any_cut_into_batches_gives_the_batch_rows(spark, tmp_path, seed, cuts):
    """Lines come shuffled within the delay, some twice, in files that are one batch each."""
    rng = random.Random(seed)
    rows = coded(seed)
    width = len(rows) / cuts
    files = [[] for _ in range(cuts)]
    for k, row in enumerate(rows):
        own = min(cuts - 1, int((k + rng.random() * 20) / width))
        files[own].append(row)
        if rng.random() < 0.2:
            files[min(cuts - 1, own + rng.randrange(2))].append(row)
    far = [(99, 10**6, None, None, START + dt.timedelta(days=9))]
    for part in [*files, far]:
        rng.shuffle(part)
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    slot = F.when(F.col("good"), F.col("actor"))
    delay = f"{int(5 * (width + 40))} seconds"
    history = live_scoring.live_history(stream, "game", "line", "actor", slot, "ts", delay)
    query = live_scoring.start(history, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("game", "line", "actor", "prev_actor", "recent")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == batch_rows(spark.createDataFrame(rows, LINES))


def test_lines_later_than_the_delay_are_left_out(spark, tmp_path):
    first = [(1, k, "a", True, START + dt.timedelta(minutes=k)) for k in range(5)]
    late = [(1, 100, "z", True, START + dt.timedelta(seconds=30)), (1, 2, "a", True, START + dt.timedelta(minutes=2))]
    far = [(9, 0, None, None, START + dt.timedelta(days=2))]
    for part in (first, far, late, [(9, 1, None, None, START + dt.timedelta(days=4))]):
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    history = live_scoring.live_history(stream, "game", "line", "actor", F.col("actor"), "ts", "1 minute")
    live_scoring.start(history, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("game = 1").select("line", "prev_actor").collect()
    assert sorted(map(tuple, got)) == [(0, None), (1, "a"), (2, "a"), (3, "a"), (4, "a")]


@pytest.mark.parametrize("buckets", [1, 5])
def test_groups_that_share_a_bucket_keep_apart(spark, tmp_path, monkeypatch, buckets):
    """Many groups, one of them NULL, over several days and triggers; few lines go back at a time."""
    monkeypatch.setattr(live_scoring, "OUT_LINES", 7)
    rng = random.Random(buckets)
    rows = [
        (rng.choice([None, *range(2**60, 2**60 + 40)]), k, rng.choice("abc"), True, START + dt.timedelta(hours=k / 4))
        for k in range(400)
    ]
    far = [(2**60, 10**6, None, None, START + dt.timedelta(days=90))]
    for part in (rows[:150], rows[100:300], rows[300:], far):
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    slot = F.when(F.col("good"), F.col("actor"))
    history = live_scoring.live_history(stream, "game", "line", "actor", slot, "ts", "2 days", buckets=buckets)
    live_scoring.start(history, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("game", "line", "actor", "prev_actor", "recent").collect()
    found, before = {}, {}
    for game, line, actor, _, _ in rows:
        last = before.setdefault(game, [])
        found[line] = (game, line, actor, last[-1] if last else None, last[-6:])
        last.append(actor)
    assert len(got) == len(rows)
    assert {r["line"]: tuple(r) for r in got} == found


@pytest.mark.parametrize("model_bytes, join", [(1 << 20, "BuildRight"), (0, "SortMergeJoin")])
def test_released_lines_are_never_broadcast(spark, tmp_path, monkeypatch, model_bytes, join):
    """The last trigger has no new line and size 0 for the planner, but releases all that waited."""
    monkeypatch.setattr(live_scoring, "MODEL_BYTES", model_bytes)
    rows = coded(7)
    far = [(99, 10**6, None, None, START + dt.timedelta(days=9))]
    for part in (rows, far):
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = [row for row in batch_rows(spark.createDataFrame(rows, LINES)) if row[3] is not None]
    frame = spark.createDataFrame(before, "game long, line long, actor string, prev string, recent array<string>")
    model = fit_frequency_model(frame.where("actor IS NOT NULL AND prev != 'e'"), ["prev"], "actor")
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    slot = F.when(F.col("good"), F.col("actor"))
    history = live_scoring.live_history(stream, "game", "line", "actor", slot, "ts", "1 day")
    scores = live_scoring.live_scores(history, model, "actor").select("line", "prev", "pred_entropy", "top_predicted")
    query = live_scoring.start(scores, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert join in plan and "BuildLeft" not in plan
    known = model.transform(frame).where("probability IS NOT NULL")
    masked = E.mask_to_available(known, model.classes, F.col("recent"))
    want = E.add_predictability(masked, "actor", len(model.classes)).select(*scores.columns)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() > 100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("block_rows", [None, 7])
def test_updating_over_blocks(spark, block_rows):
    rng = random.Random(4)
    rows = [(k % 2 if k < 30 else 0, k, rng.choice(["a", "b", "c", None])) for k in range(90)]
    frame = spark.createDataFrame(rows, "g long, k long, actor string")
    counted = add_counts_so_far(Ordered.by_position(frame, ["g"], "k", block_rows), "actor", ["a", "b", "c"]).df
    prior = counted.withColumn("probability", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25)))
    for r in add_updated(prior, 4.0, 3).collect():
        earlier = [x for g, k, x in rows if g == r["g"] and k < r["k"]]
        seen = [earlier.count(x) for x in "abc"]
        assert r["seen"] == seen
        want = [(4 * p + n) / (4 + sum(seen)) for p, n in zip((0.5, 0.25, 0.25), seen)]
        assert r["probability"] == pytest.approx(want)
    nothing = add_updated(prior.withColumn("probability", F.lit(None).cast("array<double>")), 4.0, 3)
    assert nothing.where("probability IS NOT NULL").count() == 0
    first = add_updated(prior, 0.0, 3).where("k = 0").first()
    assert first["probability"] is None


def test_brier_score(spark):
    rows = [([0.7, 0.3], "a", 0.18), ([0.7, 0.3], "b", 0.98), ([0.0, 0.0], "a", 1.0), ([0.5, 0.5], "x", 1.5), ([1.0, 0.0], None, 2.0)]
    frame = spark.createDataFrame(rows, "p array<double>, actual string, want double")
    score = brier(F.col("p"), F.array(F.lit("a"), F.lit("b")), F.col("actual"))
    for r in frame.withColumn("got", score).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_reliability_bins_have_near_equal_mass_and_add_up(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y"]), c := rng.random(), rng.random() < c) for _ in range(4000)] + [("x", None, True), ("x", 1.0, None)]
    frame = spark.createDataFrame(rows, "period string, c double, hit boolean")
    cells = confidence_cells(frame, F.col("c"), F.col("hit"), ["period"])
    parts = [confidence_cells(part, F.col("c"), F.col("hit"), ["period"]) for part in frame.randomSplit([0.3, 0.7], 1)]
    merged = merged_cells(parts[0].union(parts[1]), ["period"])
    keep = lambda f: sorted((r["period"], r["cell"], r["n"], r["hits"], round(r["total"], 9)) for r in f.collect())
    assert keep(cells) == keep(merged)
    table = reliability(cells, 10, ["period"])
    rows = table.collect()
    for period in "xy":
        own = [r["n"] for r in rows if r["period"] == period]
        assert len(own) == 10 and max(own) - min(own) < 0.05 * sum(own)
    assert all(abs(r["mean_confidence"] - r["hit_rate"]) < 0.12 for r in rows)
    assert all(0 <= r["calibration_error"] < 0.06 for r in calibration_error(table, ["period"]).collect())
    flat = confidence_cells(frame.withColumn("c", F.lit(0.5)), F.col("c"), F.col("hit"))
    assert [r["bin"] for r in reliability(flat, 10).collect()] == [0]


def test_sparse_probabilities_equal_dense_ones(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice("xyz"), rng.choice("abcde"), [rng.choice(["a", "b", "c", "d", "e", None]) for _ in range(rng.randrange(5))]) for k in range(400)]
    frame = spark.createDataFrame(rows, "k long, key string, actor string, court array<string>")
    train = frame.where("k < 200 AND key != 'z' AND actor != 'e'").union(frame.where("k < 4"))
    dense = fit_frequency_model(train, ["key"], "actor")
    known = dense.transform(frame).where("probability IS NOT NULL")
    want = E.add_predictability(E.mask_to_available(known, dense.classes, F.col("court")), "actor", len(dense.classes))
    sparse = fit_sparse_frequency_model(train, ["key"], "actor")
    found = sparse.available_probabilities(frame, ["k"], "court").where("probability IS NOT NULL")
    got = E.add_sparse_predictability(found, "actor", F.col("court"))
    names = ["k", "pred_entropy", "top_predicted", "prediction_correct", "chose_non_top"]
    plain = lambda f: sorted((r[0], round(r[1], 9), *r[2:]) for r in f.select(*names).collect())
    assert plain(got) == plain(want)
    sums = got.select(S.total(F.col("probability")).alias("s")).collect()
    assert all(r["s"] == 0 or abs(r["s"] - 1) < 1e-9 for r in sums)
