"""Feature rows, dictionaries, lags and profiles."""

import pytest
from pyspark.sql import functions as F

from rallyframe.functions import columns as C
from rallyframe.operators import features as X
from rallyframe.operators import labels as L
from rallyframe.operators.profiles import add_profile, fit_profile, top_codes
from rallyframe.schema import SEASON
from rallyframe.sources.season import canonical_ids


def season_table(spark, rows):
    """Rows from partial dicts: a home side A that receives, unless told otherwise."""
    full = []
    for row in rows:
        base = {
            "game_number": 1,
            "period": "pre",
            "split": "train",
            "set_number": 1,
            "receiving_team": "A",
            "serving_team": "B",
            "home_team": "A",
            "visiting_team": "B",
            "home_setter_position": 1,
            "visiting_setter_position": 6,
            "receive_eval_code": "#",
            "server_id": "-50",
            "attacker_id": "-1",
            "attack_code": "X5",
            "point_won_by": "B",
            "score_diff": 0,
            "no_attack": False,
            **{f"home_player_id{n}": f"-{n}" for n in range(1, 7)},
            **{f"visiting_player_id{n}": f"-5{n}" for n in range(1, 7)},
        }
        base.update(row)
        full.append(tuple(base.get(name) for name in SEASON.fieldNames()))
    return canonical_ids(spark.createDataFrame(full, SEASON))


def test_pass_quality_and_rotation(spark):
    codes = ["#", "+", "!", "-", "/", "=", "?", None]
    positions = [1, 6, 5, 4, 3, 2, 9, None]
    rows = [
        {"point_id": n, "receive_eval_code": code, "home_setter_position": position}
        for n, (code, position) in enumerate(zip(codes, positions), 1)
    ]
    got = X.base_features(season_table(spark, rows), "A").orderBy("point_id").collect()
    assert [row.pass_quality for row in got] == [4.0, 3.0, 2.0, 1.0, 0.5, 0.0, None, None]
    assert [row.receiving_rotation for row in got] == [1, 2, 3, 4, 5, 6, None, None]


def test_roles_follow_the_receiving_side(spark):
    rows = [
        {"point_id": 1},
        {"point_id": 2, "home_team": "B", "visiting_team": "A"},
        {"point_id": 3, "receiving_team": "B", "serving_team": "A"},
        {"point_id": 4, "no_attack": True},
    ]
    got = X.base_features(season_table(spark, rows), "A").orderBy("point_id").collect()
    assert [row.point_id for row in got] == [1, 2]
    assert (got[0].recv_p1, got[0].opp_p1, got[0].receiving_rotation) == ("-1", "-51", 1)
    assert (got[1].recv_p1, got[1].opp_p1, got[1].receiving_rotation) == ("-51", "-1", 2)


def test_gated_lag(spark):
    rows = [
        {"point_id": 4, "attacker_id": "-1"},
        {"point_id": 5, "attacker_id": "-2", "point_won_by": "A"},
        {"point_id": 6, "no_attack": True},
        {"point_id": 7, "attacker_id": "-3"},
        {"point_id": 8, "set_number": 2, "attacker_id": "-4"},
        {"point_id": 9, "set_number": 2, "attacker_id": "-4"},
        {"point_id": 10, "set_number": 2, "game_number": 2},
    ]
    got = X.base_features(season_table(spark, rows), "A").orderBy("game_number", "point_id").collect()
    assert [row.prev_attacker_id for row in got] == ["none", "-1", "none", "none", "-4", "none"]
    assert [row.prev_point_won for row in got] == [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_ungated_lag(spark):
    rows = [
        {"point_id": 4, "attacker_id": "-1"},
        {"point_id": 5, "attacker_id": "-2", "point_won_by": "A"},
        {"point_id": 9, "attacker_id": "-3", "set_number": 2, "point_won_by": None},
        {"point_id": 12, "set_number": 2},
    ]
    got = X.base_features(season_table(spark, rows), "A", gated_lag=False).orderBy("point_id").collect()
    assert [row.prev_attacker_id for row in got] == ["none", "-1", "-2", "-3"]
    assert [row.prev_point_won for row in got] == [0.0, 0.0, 1.0, 0.0]


def test_dictionaries_are_fitted_on_training_rows(spark):
    train = season_table(
        spark,
        [
            {"point_id": 1, "attacker_id": "-9", "server_id": "-60"},
            {"point_id": 2, "attacker_id": "-10", "home_player_id3": None},
            {"point_id": 3, "attacker_id": "-100"},
        ],
    )
    test = season_table(
        spark,
        [
            {"point_id": 1, "attacker_id": "-9.0", "server_id": "-61"},
            {"point_id": 2, "attacker_id": "-77", "server_id": "-60.0", "home_player_id1": "-999"},
        ],
    )
    model = X.FeatureBuilder("A").fit(train)
    classes = {row.label: row.idx for row in model.targets.collect()}
    assert classes == {"-10": 0, "-100": 1, "-9": 2}
    players = {row.label: row.idx for row in model.players.collect()}
    assert sorted(players, key=players.get) == sorted(players)
    assert "nan" in players and len(players) == 13
    got = model.transform(test).orderBy("point_id").collect()
    assert [row.target for row in got] == [2, None]
    servers = {row.label: row.idx for row in model.servers.collect()}
    assert [row.server_encoded for row in got] == [-1, servers["-60"]]
    assert got[1].recv_p1_enc == -1
    assert got[0].recv_p1_enc == players["-1"]
    fitted = model.transform(train).orderBy("point_id").collect()
    assert fitted[1].recv_p3_enc == players["nan"]


def test_periods_have_their_own_dictionaries(spark):
    rows = [
        {"point_id": 1, "period": "pre", "attacker_id": "-1"},
        {"point_id": 1, "period": "conf1", "attacker_id": "-2", "game_number": 2},
        {"point_id": 2, "period": "conf1", "attacker_id": "-3", "game_number": 2},
    ]
    season = season_table(spark, rows)
    model = X.FeatureBuilder("A").fit(season)
    got = {(row.period, row.label): row.idx for row in model.targets.collect()}
    assert got == {("pre", "-1"): 0, ("conf1", "-2"): 0, ("conf1", "-3"): 1}
    assert {row.target for row in model.transform(season).collect()} == {0, 1}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_both_ways_to_number_labels_agree(spark, keys):
    rows = [(f"k{n % 3}", f"-{n * 7919 % 4001}") for n in range(3000)]
    df = spark.createDataFrame(rows, "k string, label string")
    distinct = L.distinct_labels(df, "label", keys)
    small, spread, free = (
        sorted(L.rank_labels(L.spread_labels(distinct, "label", ranges), "label", keys).collect())
        for ranges in (1, 7, None)
    )
    assert small == spread == free
    assert L.spread_labels(distinct, "label", 7).select(L.RANGE).distinct().count() == 7
    if not keys:
        labels = sorted({label for _, label in rows})
        assert [tuple(row) for row in small] == [(label, place) for place, label in enumerate(labels)]


def test_encode_keeps_rows_and_marks_unseen(spark):
    dictionary = spark.createDataFrame([("a", 0), ("nan", 1)], "label string, idx int")
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, v string")
    got = L.encode(df, dictionary, C.label_text(F.col("v")), "enc", "label").orderBy("id").collect()
    assert [row.enc for row in got] == [0, 1, -1]


def test_top_code_ties_and_missing_codes(spark):
    rows = [("p", "X6"), ("p", "X5"), ("q", None), ("r", "V5"), ("r", "V5"), ("r", "X1")]
    df = spark.createDataFrame(rows, "attacker_id string, attack_code string")
    top = {row.attacker_id: (row.attack_code, row.share) for row in top_codes(df, "attacker_id", "attack_code").collect()}
    assert top == {"p": ("X5", 0.5), "r": ("V5", 2 / 3)}
    profile = fit_profile(df, "attacker_id", "attack_code", "enc")
    got = {row.attacker_id: row.enc for row in add_profile(df, profile, "attacker_id", "enc").collect()}
    assert got == {"p": 1, "q": None, "r": 0}


def test_profile_is_off_by_default(spark):
    season = season_table(spark, [{"point_id": 1}])
    assert "player_top_attack_enc" not in X.FeatureBuilder("A").fit(season).transform(season).columns
    model = X.FeatureBuilder("A", include_attacker_profile=True).fit(season)
    assert model.transform(season).first().player_top_attack_enc == 0


def test_canonical_ids(spark):
    df = spark.createDataFrame([("-9",), ("-9.0",), (" -9",), ("x7",), (None,), ("-9223372036854775807",)], "v string")
    got = [row[0] for row in df.select(C.canonical_id(F.col("v"))).collect()]
    assert got == ["-9", "-9", "-9", "x7", None, "-9223372036854775807"]


def test_twelve_lookups_share_one_broadcast(spark, monkeypatch):
    """Where the dictionary is too large for a map, and joined for each column."""
    monkeypatch.setattr(L, "MAP_ENTRIES", 0)
    season = season_table(spark, [{"point_id": n} for n in range(1, 5)])
    model = X.FeatureBuilder("A").fit(season)
    rows = model.transform(season)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 11
    assert "SortMergeJoin" not in plan


def test_small_player_dictionaries_need_no_join(spark):
    season = season_table(spark, [{"point_id": n} for n in range(1, 5)])
    rows = X.FeatureBuilder("A", include_attacker_profile=True).fit(season).transform(season)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Join ") <= 6


@pytest.mark.parametrize("entries", [1 << 14, 0])
@pytest.mark.parametrize("keys", [[], ["period"], ["period", "part"]])
def test_one_lookup_for_many_columns(spark, monkeypatch, entries, keys):
    """As a join for each column, whether the dictionary is sent as a map or joined; nulls and strangers included."""
    monkeypatch.setattr(L, "MAP_ENTRIES", entries)
    names = ["", "a", "b", "é", "nan", None, "stranger"]
    data = [
        (i, ["x", "y", None][i % 3], i % 2, names[i % 7], names[i * 3 % 7], names[i * 5 % 7]) for i in range(84)
    ]
    df = spark.createDataFrame(data, "id int, period string, part int, p string, q string, r string")
    known = df.where("period IS NOT NULL AND part = 0").select(*keys, F.explode(F.array("p", "q")).alias("label"))
    dictionary = L.fit_dictionary(known.where("label <> 'stranger'"), "label", keys)
    columns = {f"{name}_enc": F.col(name) for name in "pqr"}
    for unseen in (L.UNSEEN, None):
        want = df
        for output, value in columns.items():
            want = L.encode(want, dictionary, value, output, "label", keys, unseen=unseen)
        got = L.encode_all(df, dictionary, columns, "label", keys, unseen=unseen)
        assert got.schema.names == [*df.columns, *columns]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
        assert ("Join" in got._jdf.queryExecution().toString()) == (entries == 0)


def test_one_lookup_in_an_empty_dictionary(spark):
    df = spark.createDataFrame([("a", "b"), (None, "a")], "p string, q string")
    nothing = spark.createDataFrame([], "label string, idx int")
    got = L.encode_all(df, nothing, {"x": F.col("p"), "y": F.col("q")}, "label")
    assert {(row.x, row.y) for row in got.collect()} == {(-1, -1)}
