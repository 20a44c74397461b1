"""Touch tables to points: first rows, names, flags, lag."""

import random

from pyspark.sql import functions as F

from rallyframe.operators import points as P
from rallyframe.operators.lookups import ids_with_several_names
from rallyframe.schema import player_id_columns, shirt_columns

SAME = {
    "home_team": "A",
    "visiting_team": "B",
    "home_team_id": "1",
    "visiting_team_id": "2",
    "home_team_score": 3,
    "visiting_team_score": 5,
    "home_setter_position": 1,
    "visiting_setter_position": 6,
}
SCHEMA = (
    "game_number int, line_no int, point_id int, set_number int, skill string, team string, "
    "evaluation_code string, phase string, player_id string, player_name string, set_code string, "
    "set_type string, attack_code string, point_won_by string, home_team string, visiting_team string, "
    "home_team_id string, visiting_team_id string, home_team_score int, visiting_team_score int, "
    "home_setter_position int, visiting_setter_position int, "
    + ", ".join(f"{c} int" for c in shirt_columns("home") + shirt_columns("visiting"))
    + ", "
    + ", ".join(f"{c} string" for c in player_id_columns("home") + player_id_columns("visiting"))
)


def touch(line, point, skill, team, evaluation, player=None, name=None, phase=None, game=1, **more):
    return {
        "game_number": game,
        "line_no": line,
        "point_id": point,
        "set_number": 1,
        "skill": skill,
        "team": team,
        "evaluation_code": evaluation,
        "phase": phase,
        "player_id": player,
        "player_name": name,
        **SAME,
        **more,
    }


def table(spark, rows):
    rows = list(rows)
    random.Random(7).shuffle(rows)
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], SCHEMA).repartition(3)


ROWS = [
    touch(1, 1, "Serve", "B", "-", "-21", "Bo", "Serve"),
    touch(2, 1, "Reception", "A", "#", "-11", "An", "Reception"),
    touch(3, 1, "Set", "A", "#", "-12", "Al", "Reception", set_code="K1", set_type="F"),
    touch(4, 1, "Attack", "A", "+", "-13", "Ab", "Reception", attack_code="X5"),
    touch(5, 1, "Attack", "A", "#", "-14", "Ac", "Reception", attack_code="X6"),
    touch(6, 1, None, None, None, point_won_by="A"),
    # a name spelled in two ways, a missing evaluation, no set, no attack
    touch(7, 2, "Serve", "A", None, "-11", "Anna", "Serve"),
    touch(8, 2, "Reception", "B", None, "-22", "Bi", "Reception"),
    touch(9, 2, None, None, None, point_won_by="B"),
    # a serve that was not received
    touch(10, 3, "Serve", "B", "=", "-21", "Bo", "Serve"),
    # attack without a code, transition attack only counts when in the reception phase
    touch(11, 4, "Serve", "B", "#", "-21", "Bo", "Serve"),
    touch(12, 4, "Reception", "A", "=", "-11", "An", "Reception"),
    touch(13, 4, "Attack", "A", "=", "-15", "Ad", "Transition", attack_code="X9"),
    # both roles on the same side: dropped
    touch(14, 5, "Serve", "A", "-", "-11", "An", "Serve"),
    touch(15, 5, "Reception", "A", "-", "-12", "Al", "Reception"),
    # second game: the lag starts again
    touch(1, 1, "Serve", "B", "/", "-21", "Bo", "Serve", game=2),
    touch(2, 1, "Reception", "A", "/", "-11", "An", "Reception", game=2),
    touch(3, 1, "Attack", "A", "+", "-13", "Ab", "Reception", game=2),
]


def rows_by_point(spark, focus_id="1"):
    rows = P.serve_receive(table(spark, ROWS), focus_id, "A", game="game_number").collect()
    return {(row.game_number, row.point_id): row for row in rows}


def test_points_kept(spark):
    assert set(rows_by_point(spark)) == {(1, 1), (1, 2), (1, 4), (2, 1)}


def test_first_attack_wins_in_any_row_order(spark):
    row = rows_by_point(spark)[1, 1]
    assert (row.attacker_id, row.attack_code, row.attack_eval_code) == ("-13", "X5", "+")
    assert (row.setter_name, row.set_code, row.set_type, row.point_won_by) == ("Al", "K1", "F", "A")


def test_one_name_per_id(spark):
    row = rows_by_point(spark)[1, 2]
    assert row.server_name == "An"
    several = ids_with_several_names(table(spark, ROWS), ["game_number"], "player_id", "player_name")
    assert [(row.player_id, row.n_names) for row in several.collect()] == [("-11", 2)]


def test_flags_keep_three_values(spark):
    rows = rows_by_point(spark)
    missing = rows[1, 2]
    assert missing.is_ace is None
    assert missing.is_overpass is None
    assert missing.out_of_system is False
    assert (missing.no_set, missing.no_attack) == (True, True)
    assert rows[1, 4].is_ace is True
    assert rows[1, 4].is_overpass is True  # a lost reception counts as one
    assert rows[1, 4].no_attack is True  # only a transition attack
    assert rows[2, 1].is_overpass is True
    assert rows[2, 1].no_attack is False and rows[2, 1].attack_code is None


def test_score_difference_from_either_side(spark):
    assert rows_by_point(spark, "1")[1, 1].score_diff == -2
    assert rows_by_point(spark, "2")[1, 1].score_diff == 2
    assert rows_by_point(spark, "9")[1, 1].score_diff is None


def test_previous_outcome(spark):
    rows = rows_by_point(spark)
    assert rows[1, 1].prev_point_won is None
    assert rows[1, 2].prev_point_won is True
    assert rows[1, 4].prev_point_won is False
    assert rows[2, 1].prev_point_won is None


def test_result_does_not_depend_on_partitioning(spark):
    one = P.serve_receive(table(spark, ROWS).coalesce(1), "1", "A", game="game_number")
    many = P.serve_receive(table(spark, ROWS).repartition(11), "1", "A", game="game_number")
    assert sorted(one.collect()) == sorted(many.collect())


def test_first_rows_take_one_shuffle(spark):
    plan = P.assemble_points(table(spark, ROWS).where(F.col("line_no") > 0), "game_number")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
