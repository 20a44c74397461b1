"""Whole analyses on invented matches."""

import math

import pytest
from pyspark.sql import functions as F

from rallyframe import api
from rallyframe.plans import match, overview
from rallyframe.plans.match import analyse_match
from rallyframe.plans.season import analyse_season
from rallyframe.schema import MODEL_FEATURES
from rallyframe.session import settle
from rallyframe.sources.season import extract_match, load_season
from tests.scoutgen import Match, write_season

QUICK = {"max_iter": 3, "max_depth": 2, "step_size": 0.1, "subsample": 0.8, "seed": 42}
GAMES = {
    "01_pre_train_vs_A.dvw": 11,
    "02_pre_train_vs_B.dvw": 12,
    "03_pre_test_vs_C.dvw": 13,
    "11_conf1_train_vs_D.dvw": 14,
    "12_conf1_test_vs_E.dvw": 15,
}


@pytest.fixture(scope="module")
def season(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("season")
    write_season(folder, GAMES)
    return settle(load_season(spark, str(folder), "1", "Team A").rows)


@pytest.fixture(scope="module")
def analysis(season):
    return analyse_season(season, "Team A", settings=QUICK)


def test_every_usable_row_is_scored_once(season, analysis):
    expected = 0
    for name, seed in GAMES.items():
        expected += sum(
            row["receiving_team"] == "Team A" and not row["no_attack"] for row in Match(seed).expected
        )
    scored = analysis.scored
    known = analysis.features.targets.withColumnRenamed("label", "attacker_id")
    lost = season.where("receiving_team = 'Team A' AND NOT no_attack").join(
        known, ["period", "attacker_id"], "left_anti"
    )
    assert scored.count() == expected - lost.count()
    assert scored.select("game_number", "point_id").distinct().count() == scored.count()


def test_scores_are_consistent(analysis):
    for row in analysis.scored.collect():
        court = {row[f"recv_p{slot}"] for slot in range(1, 7)}
        for name, p in zip(row.classes, row.probability):
            assert p == 0 or name in court
        assert sum(row.probability) == pytest.approx(1) or sum(row.probability) == 0
        assert row.pred_entropy <= math.log(len(row.classes)) + 1e-9
        assert all(row[name] is not None for name in MODEL_FEATURES)


def test_periods_are_compared(analysis):
    assert list(analysis.models) == ["pre", "conf1"]
    wide = analysis.comparison()
    assert wide.columns == ["metric", "pre", "conf1"]
    assert wide.count() == 6
    assert analysis.by_rotation().count() == 12
    shown = {(row.period, row.metric): row.shown for row in analysis.listed_summary().collect()}
    assert shown["pre", "overall_accuracy"].endswith("%")
    assert analysis.log_loss().count() == 2
    assert analysis.importances().count() == 2 * len(MODEL_FEATURES)
    tests = analysis.scored.where("split = 'test'").groupBy("period").count().collect()
    support = analysis.report().groupBy("period").agg(F.sum("support").alias("n")).collect()
    assert {(row.period, row["count"]) for row in tests} == {(row.period, row.n) for row in support}


def test_profile_feature_can_be_added(season):
    one = season.where("period = 'pre'")
    analysis = analyse_season(one, "Team A", ["pre"], include_attacker_profile=True, settings=QUICK)
    assert "player_top_attack_enc" in analysis.models["pre"].features


def test_step_by_step(spark, season, capsys):
    train = season.where("period = 'pre' AND split = 'train'")
    test = season.where("period = 'pre' AND split = 'test'")
    rows, features = api.build_features(train, "Team A")
    others, same = api.build_features(test, "Team A", features)
    assert same is features
    names = api.classes(features)
    complete = rows.na.drop(subset=[*MODEL_FEATURES, "target"])
    model = api.fit_boosted_model(complete, MODEL_FEATURES, "target", names, **QUICK)
    scored, summary = api.compute_predictability(api.get_masked_probas(others, model))
    assert scored.count() == others.na.drop(subset=[*MODEL_FEATURES, "target"]).count()
    values = {row.metric: row.value for row in summary.collect()}
    assert values["overall_accuracy"] + values["non_top_rate_all"] == pytest.approx(1)
    series = {(row.metric, row.rotation): row.value for row in summary.where("rotation IS NOT NULL").collect()}
    for rotation, in scored.select("receiving_rotation").distinct().collect():
        here = scored.where(F.col("receiving_rotation") == rotation)
        want = here.agg(F.avg("pred_entropy"), F.avg(F.col("chose_non_top").cast("double"))).first()
        assert series["entropy_by_rotation", rotation] == pytest.approx(want[0])
        assert series["non_top_by_rotation", rotation] == pytest.approx(want[1])
    api.print_predictability_summary(summary, "test")
    assert "overall_accuracy" in capsys.readouterr().out
    again, targets = api.encode_target(others, rows)
    assert sorted(row.target or -1 for row in again.collect()) == sorted(row.target or -1 for row in others.collect())
    assert targets.count() == len(names)
    profiled, profiles = api.add_attack_profiles(rows, rows)
    assert profiled.count() == rows.count()
    assert profiles.count() <= len(names)


def test_no_training_rows_is_an_error(season):
    with pytest.raises(ValueError):
        analyse_season(season.where("split = 'test'"), "Team A", settings=QUICK)


def test_single_match(spark, tmp_path):
    path = tmp_path / "X-Y.dvw"
    path.write_text(Match(21, sets=5, rallies=24).text())
    rows = settle(extract_match(spark, str(path), "1", "Team A"))
    analysis = analyse_match(rows, "Team A", settings={**QUICK, "subsample": 1.0})
    seen = {row.set_number for row in analysis.scored.select("set_number").distinct().collect()}
    assert seen == {1, 2, 3, 4, 5}
    assert analysis.report().agg(F.sum("support")).first()[0] == analysis.test_rows().count()
    assert analysis.confusion().count() == len(analysis.confusion().columns) - 1
    assert analysis.log_loss().first().n_rows == analysis.test_rows().count()
    assert analysis.summary().count() == 1
    assert analysis.by_rotation().count() == 6
    assert analysis.class_counts().agg(F.sum("n")).first()[0] == analysis.rows.count()
    assert analysis.patterns().first().n_rows == analysis.scored.count()
    assert analysis.diagnostics().count() == 3
    example = analysis.example().collect()
    assert sum(row.p for row in example) == pytest.approx(1)
    train_only = analyse_match(rows, "Team A", fit_encoders_on="train", settings={**QUICK, "subsample": 1.0})
    assert train_only.features.servers.count() <= analysis.features.servers.count()


def test_rows_to_score_are_shared_out_over_files(spark, tmp_path, monkeypatch):
    """A match's rows are small and costly to score: by their bytes one task would score all of them."""
    path = tmp_path / "X-Y.dvw"
    path.write_text(Match(21, sets=5, rallies=24).text())
    points = settle(extract_match(spark, str(path), "1", "Team A"))
    settings = {**QUICK, "subsample": 1.0}
    whole = analyse_match(points, "Team A", settings=settings)
    monkeypatch.setattr(match, "FILE_ROWS", 10)
    shared = analyse_match(points, "Team A", settings=settings)
    files = shared.rows.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(row["count"] for row in files) <= 10
    columns = ["point_id", "attacker_id", "top_predicted", "chose_non_top"]
    assert sorted(shared.scored.select(*columns).collect()) == sorted(whole.scored.select(*columns).collect())


def test_overview(season):
    points = {(row.period, row.split): (row.points, row.games) for row in overview.points_by_period(season).collect()}
    assert points["pre", "train"] == (len(Match(11).expected) + len(Match(12).expected), 2)
    everything = [row for seed in GAMES.values() for row in Match(seed).expected]
    rates = {row.flag: row.n for row in overview.situation_rates(season).collect()}
    for flag in rates:
        assert rates[flag] == sum(bool(row[flag]) for row in everything)
    assert [row.set_number for row in overview.sets_present(season).collect()] == [1, 2, 3]
    attackers = overview.attacker_counts(season).collect()
    assert sum(row.n for row in attackers) == sum(not row["no_attack"] for row in everything)
    assert attackers == sorted(attackers, key=lambda row: (-row.n, row.attacker_id))
    assert overview.first_rows(season, 3).count() == 3
    assert overview.receive_codes(season).count() > 3
    assert overview.setter_positions(season, "home").count() > 1
    assert overview.points_by_set(season).count() == 3
    assert overview.attack_counts(season).count() > 3
