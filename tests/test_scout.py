"""Match files in, serve-receive rows out."""

import pytest
from pyspark.sql import functions as F

from rallyframe.schema import BASIC_COLUMNS, SERVE_RECEIVE
from rallyframe.sources import scout, season
from rallyframe.streaming import season_stream
from tests.scoutgen import Match, write_season

GAMES = {
    "01_pre_train_vs_X.dvw": 1,
    "09_pre_test_vs_Y Y.dvw": 2,
    "11_conf1_train_vs_Z.dvw": 3,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("scout")
    write_season(path, GAMES)
    (path / "X-Y.dvw").write_text(Match(4).text())
    (path / "xx_pre_train_vs_Q.dvw").write_text(Match(5).text())
    (path / "12_conf1_test_vs_E.dvw").write_text("[3TEAMS]\n1;Team A;0;\n2;Team B;0;\n")
    (path / "notes.txt").write_text("not a match file")
    return path


@pytest.fixture(scope="module")
def loaded(spark, folder):
    return season.load_season(spark, str(folder), "1", "Team A")


def as_rows(df, game):
    return [row.asDict() for row in df.where(F.col("game_number") == game).orderBy("point_id").collect()]


@pytest.mark.parametrize("name", GAMES)
def test_rows_match_the_match_that_was_played(loaded, name):
    match = Match(GAMES[name])
    game, period, split = int(name[:2]), name.split("_")[1], name.split("_")[2]
    got = as_rows(loaded.rows, game)
    assert len(got) == len(match.expected) > 20
    for row, want in zip(got, match.expected):
        assert (row.pop("game_number"), row.pop("period"), row.pop("split")) == (game, period, split)
        assert row.pop("source_file").endswith(name.replace(" ", "%20"))
        assert row == want


def test_columns_are_the_declared_ones(loaded):
    assert loaded.rows.columns[: len(SERVE_RECEIVE)] == SERVE_RECEIVE.fieldNames()
    assert len(SERVE_RECEIVE) == 58
    assert len(loaded.rows.select(*BASIC_COLUMNS).columns) == 52


def test_files_that_cannot_be_used_are_listed(loaded):
    reasons = {row.file_name: row.reason for row in loaded.rejects.collect()}
    assert reasons == {
        "X-Y.dvw": "name has fewer than three parts",
        "xx_pre_train_vs_Q.dvw": "game number is not an integer",
        "12_conf1_test_vs_E.dvw": "no serve-receive point",
    }


def test_no_usable_file_is_an_error(spark, tmp_path):
    (tmp_path / "bad.dvw").write_text("x")
    with pytest.raises(ValueError):
        season.load_season(spark, str(tmp_path), "1", "Team A")


def test_touch_invariants(spark, folder):
    touches = scout.touches(scout.read_lines(spark, str(folder / "01_pre_train_vs_X.dvw"))).cache()
    match = Match(1)
    points = [line for line in match.lines if line[1:2] == "p"]
    serves = touches.where("skill = 'Serve'")
    assert serves.count() == len(points) == touches.select("point_id").distinct().count()
    assert touches.where("skill = 'Reception'").count() <= len(points)
    assert touches.where("skill = 'Serve' AND phase <> 'Serve'").count() == 0
    first = touches.groupBy("set_number").agg(
        F.min_by(F.struct("home_team_score", "visiting_team_score"), "line_no").alias("s")
    )
    assert {tuple(row.s) for row in first.collect()} == {(0, 0)}
    overpass = touches.where("attack_code IN ('X9', 'X1') OR set_code IN ('K9', 'K7')")
    assert {row.phase for row in overpass.collect()} == {"Transition"}
    touches.unpersist()


def test_header_sections(spark, folder):
    path = str(folder / "01_pre_train_vs_X.dvw")
    tagged = scout.tag_sections(scout.order_lines(scout.read_lines(spark, path), splittable=False)).df
    assert scout.roster(tagged).count() == 16
    libero = scout.roster(tagged).where("is_libero").orderBy("side").collect()
    assert [(row.side, row.shirt) for row in libero] == [("*", 18), ("a", 33)]
    results = scout.set_results(tagged).orderBy("set_number").collect()
    assert [row.final_score for row in results] == Match(1).finals
    codes = {row.code: (row.kind, row.zone, row.description, row.target) for row in scout.code_table(tagged).collect()}
    assert codes["X5"] == ("attack", 3, "Wide step", "C")
    assert codes["K1"] == ("set", None, "Fast middle", None)


def test_a_file_read_in_many_splits_gives_the_same_rows(spark, folder):
    """Lines of one file in several tasks, with sections and points running across the cuts."""
    path = str(folder / "01_pre_train_vs_X.dvw")
    whole = season.extract_match(spark, path, "1", "Team A")
    want = sorted(whole.collect())
    settings = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "2000"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        lines = scout.read_lines(spark, path)
        assert scout.has_splittable_files(spark, path)
        assert lines.select("block").distinct().count() > 5
        got = sorted(season.extract_match(spark, path, "1", "Team A").collect())
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert got == want


def test_store_and_update(spark, folder, tmp_path):
    path = str(tmp_path / "season")
    source = tmp_path / "games"
    source.mkdir()
    (source / "01_pre_train_vs_X.dvw").write_text(Match(1).text())
    first = season.update_season(spark, str(source), path, "1", "Team A").rows
    assert first.select("game_number").distinct().count() == 1
    stamps = {f: f.stat().st_mtime_ns for f in (tmp_path / "season").rglob("*.parquet")}
    (source / "02_pre_train_vs_Y.dvw").write_text(Match(2).text())
    second = season.update_season(spark, str(source), path, "1", "Team A").rows
    assert sorted(row.game_number for row in second.select("game_number").distinct().collect()) == [1, 2]
    for file, stamp in stamps.items():
        assert file.stat().st_mtime_ns == stamp
    stored = sorted(second.collect())
    again = season.update_season(spark, str(source), path, "1", "Team A").rows
    assert sorted(again.collect()) == stored
    forced = season.update_season(spark, str(source), path, "1", "Team A", force=True).rows
    assert sorted(forced.collect()) == stored


def test_files_of_one_game_are_all_kept(spark, tmp_path, monkeypatch):
    """Two files with one game number, and one without a point: by update, and by stream."""
    monkeypatch.setattr(season, "FILES_PER_LOAD", 1)
    source, path, streamed = tmp_path / "games", str(tmp_path / "season"), str(tmp_path / "streamed")
    source.mkdir()
    (source / "01_pre_train_vs_X.dvw").write_text(Match(1).text())
    season.update_season(spark, str(source), path, "1", "Team A")
    season_stream.run_available(spark, str(source), streamed, str(tmp_path / "progress"), "1", "Team A")
    (source / "01_conf1_test_vs_Y.dvw").write_text(Match(2).text())
    (source / "01_pre_test_vs_Z.dvw").write_text(Match(3).text())
    (source / "07_pre_test_vs_E.dvw").write_text("[3TEAMS]\n1;Team A;0;\n2;Team B;0;\n")
    (source / "X-Y.dvw").write_text(Match(4).text())
    updated = season.update_season(spark, str(source), path, "1", "Team A")
    season_stream.run_available(spark, str(source), streamed, str(tmp_path / "progress"), "1", "Team A")
    whole = sorted(season.load_season(spark, str(source), "1", "Team A").rows.collect())
    assert len(whole) == sum(len(Match(seed).expected) for seed in (1, 2, 3))
    assert sorted(updated.rows.collect()) == whole
    assert sorted(season.read_season(spark, streamed).collect()) == whole
    reasons = {row.file_name: row.reason for row in updated.rejects.collect()}
    assert reasons == {"07_pre_test_vs_E.dvw": "no serve-receive point", "X-Y.dvw": "name has fewer than three parts"}
    listed = {row.file_name for row in season.read_files(spark, streamed).collect()}
    assert listed == {row.file_name for row in season.read_files(spark, path).collect()}


def test_stream_picks_up_new_files_only(spark, tmp_path):
    source, path, checkpoint = tmp_path / "games", str(tmp_path / "season"), str(tmp_path / "progress")
    source.mkdir()
    (source / "01_pre_train_vs_X.dvw").write_text(Match(1).text())
    (source / "X-Y.dvw").write_text(Match(4).text())
    season_stream.run_available(spark, str(source), path, checkpoint, "1", "Team A")
    one = season.read_season(spark, path).collect()
    whole = season.load_season(spark, str(source), "1", "Team A").rows.collect()
    assert sorted(one) == sorted(whole)
    stamps = {f: f.stat().st_mtime_ns for f in (tmp_path / "season").rglob("*.parquet")}
    (source / "02 _pre_test_vs_Y+Z.dvw").write_text(Match(2).text())
    season_stream.run_available(spark, str(source), path, checkpoint, "1", "Team A")
    both = season.read_season(spark, path)
    assert sorted(row.game_number for row in both.select("game_number").distinct().collect()) == [1, 2]
    assert both.where("game_number = 2").count() == len(Match(2).expected)
    for file, stamp in stamps.items():
        assert file.stat().st_mtime_ns == stamp
    season_stream.run_available(spark, str(source), path, checkpoint, "1", "Team A")
    assert season.read_season(spark, path).count() == len(Match(1).expected) + len(Match(2).expected)


def test_csv_round_trip(spark, loaded, tmp_path):
    path = str(tmp_path / "csv")
    season.write_csv(loaded.rows, path)
    assert sorted(map(str, season.read_csv(spark, path, tagged=True).collect())) == sorted(
        map(str, loaded.rows.collect())
    )


def test_csv_ids_written_as_numbers(spark, tmp_path):
    names = SERVE_RECEIVE.fieldNames()
    line = {name: "NA" for name in names} | {"point_id": "4", "attacker_id": "-9.0", "home_player_id1": "-12"}
    (tmp_path / "m.csv").write_text(",".join(names) + "\n" + ",".join(line[name] for name in names) + "\n")
    row = season.read_csv(spark, str(tmp_path)).first()
    assert (row.point_id, row.attacker_id, row.home_player_id1, row.server_id) == (4, "-9", "-12", None)


def test_pieces_combine(loaded):
    one = loaded.rows.where("game_number = 1")
    rest = loaded.rows.where("game_number <> 1")
    assert season.combine(one, rest).count() == loaded.rows.count()
