"""Touches to one row per point that starts with a serve and a reception."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.functions import columns as C
from rallyframe.operators.groups import Role, first_by_role
from rallyframe.operators.lookups import names_by_id
from rallyframe.operators.ordered import Ordered, previous
from rallyframe.schema import SERVE_RECEIVE, player_id_columns, shirt_columns
from rallyframe.session import settle

ROLES = ["server", "receiver", "setter", "attacker"]


def assemble_points(touches: DataFrame, game: str = "source_file") -> DataFrame:
    """First serve, reception, first-ball set and attack, and the outcome, of every point with a serve and a reception."""
    skill, first_ball = F.col("skill"), F.col("phase") == "Reception"
    same = [
        "set_number",
        "home_team",
        "visiting_team",
        "home_team_id",
        "visiting_team_id",
        "home_setter_position",
        "visiting_setter_position",
        *shirt_columns("home"),
        *shirt_columns("visiting"),
        *player_id_columns("home"),
        *player_id_columns("visiting"),
    ]
    player, name, evaluation = F.col("player_id"), F.col("player_name"), F.col("evaluation_code")
    roles = {
        "serve": Role(
            skill == "Serve",
            {
                **{column: F.col(column) for column in same},
                "home_score_start_of_point": F.col("home_team_score"),
                "visiting_score_start_of_point": F.col("visiting_team_score"),
                "server_id": player,
                "server_name": name,
                "serve_eval_code": evaluation,
                "serving_team": F.col("team"),
            },
        ),
        "reception": Role(
            skill == "Reception",
            {
                "receiver_id": player,
                "receiver_name": name,
                "receive_eval_code": evaluation,
                "receiving_team": F.col("team"),
            },
        ),
        "set": Role(
            (skill == "Set") & first_ball,
            {
                "setter_id": player,
                "setter_name": name,
                "set_code": F.col("set_code"),
                "set_type": F.col("set_type"),
            },
        ),
        "attack": Role(
            (skill == "Attack") & first_ball,
            {
                "attacker_id": player,
                "attacker_name": name,
                "attack_code": F.col("attack_code"),
                "attack_eval_code": evaluation,
            },
        ),
        "outcome": Role(F.col("point_won_by").isNotNull(), {"point_won_by": F.col("point_won_by")}),
    }
    return first_by_role(
        touches, [game, "point_id"], ["line_no"], roles, required=["serve", "reception"]
    )


def settle_names(points: DataFrame, touches: DataFrame, game: str = "source_file") -> DataFrame:
    """Replace the four role names by the first name each id has in its game."""
    known = names_by_id(touches, [game], "player_id", "player_name", "line_no")
    for role in ROLES:
        named = known.select(
            game, F.col("player_id").alias(f"{role}_id"), F.col("player_name").alias(f"{role}_name")
        )
        points = points.drop(f"{role}_name").join(named, [game, f"{role}_id"], "left")
    return points


def add_situation(points: DataFrame, focus_team_id: str) -> DataFrame:
    """Score difference from the focus side and the five situation flags."""
    serve, receive = F.col("serve_eval_code"), F.col("receive_eval_code")
    focus = F.lit(str(focus_team_id))
    return points.withColumns(
        {
            "score_diff": C.score_difference(
                F.col("home_team_id") == focus,
                F.col("visiting_team_id") == focus,
                F.col("home_score_start_of_point"),
                F.col("visiting_score_start_of_point"),
            ),
            "is_ace": serve == "#",
            "is_overpass": C.overpass(receive, "/", "="),
            "out_of_system": C.one_of(receive, ["-", "!"]),
            "no_set": F.col("setter_id").isNull(),
            "no_attack": F.col("attacker_id").isNull(),
        }
    )


def serve_receive(
    touches: DataFrame,
    focus_team_id: str,
    focus_team_name: str,
    game: str = "source_file",
    tags: Sequence[str] = (),
    names_unique: bool = False,
    bounded_games: bool = False,
) -> DataFrame:
    """The 58 serve-receive columns, preceded by ``game`` and ``tags``.

    ``names_unique`` skips the name lookup for touches whose ids have one name each, as read from match
    files. ``bounded_games`` says that no game can be larger than a match.
    """
    points = assemble_points(touches, game)
    if not names_unique:
        points = settle_names(points, touches, game)
    points = add_situation(points, focus_team_id).where(F.col("serving_team") != F.col("receiving_team"))
    if bounded_games:
        ordered = Ordered.bounded(points, [game], ["point_id"])
    else:  # the sizes of the games are counted first: not from the touches again
        ordered = Ordered.by_position(settle(points), [game], "point_id")
    lagged = ordered.scan(__previous=previous("point_won_by")).df.withColumn(
        "prev_point_won", F.col("__previous.point_won_by") == focus_team_name
    )
    return lagged.select(
        game, *tags, *[F.col(field.name).cast(field.dataType) for field in SERVE_RECEIVE.fields]
    )
