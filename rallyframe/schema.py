"""Column names, types and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

COURT = range(1, 7)

# --- fixed values: codes and scales defined by the scouting format ---------------------------
SKILLS = {
    "S": "Serve",
    "R": "Reception",
    "E": "Set",
    "A": "Attack",
    "B": "Block",
    "D": "Dig",
    "F": "Freeball",
}

# Setter's court position -> rotation number.
ROTATION_OF_SETTER_POSITION = {1: 1, 6: 2, 5: 3, 4: 4, 3: 5, 2: 6}

# Reception evaluation -> pass quality.
PASS_QUALITY = {"#": 4.0, "+": 3.0, "!": 2.0, "-": 1.0, "/": 0.5, "=": 0.0}

PERIODS = {"pre": "Preseason", "conf1": "First Half", "conf2": "Second Half"}

# Settings of the per-period model and of the single-match model.
SEASON_MODEL = {"max_iter": 200, "max_depth": 4, "step_size": 0.05, "subsample": 0.8, "seed": 42}
MATCH_MODEL = {"max_iter": 100, "max_depth": 3, "step_size": 0.1, "subsample": 1.0, "seed": 42}

# Smallest probability a log loss term may use (double precision machine epsilon).
EPSILON = 2.220446049250313e-16

SITUATION_FLAGS = ["is_ace", "is_overpass", "out_of_system", "no_set", "no_attack"]

MODEL_FEATURES = [
    "receiving_rotation",
    "pass_quality",
    "score_diff",
    "set_number",
    "server_encoded",
    "recv_p2_enc",
    "recv_p3_enc",
    "recv_p4_enc",
    "recv_p1_enc",
    "recv_p5_enc",
    "recv_p6_enc",
    "opp_p2_enc",
    "opp_p3_enc",
    "opp_p4_enc",
    "prev_point_won",
    "prev_attacker_enc",
]
PROFILE_FEATURE = "player_top_attack_enc"
# --- end of fixed values ---------------------------------------------------------------------

LABEL_OF_MISSING = "nan"
LABEL_OF_NO_PREVIOUS = "none"
UNSEEN = -1


def _fields(names: list[str], data_type: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, data_type) for name in names]


def shirt_columns(side: str) -> list[str]:
    return [f"{side}_p{slot}" for slot in COURT]


def player_id_columns(side: str) -> list[str]:
    return [f"{side}_player_id{slot}" for slot in COURT]


SERVE_RECEIVE = T.StructType(
    _fields(["point_id", "set_number"], T.IntegerType())
    + _fields(
        [
            "serving_team",
            "receiving_team",
            "home_team",
            "visiting_team",
            "home_team_id",
            "visiting_team_id",
        ],
        T.StringType(),
    )
    + _fields(["home_setter_position", "visiting_setter_position"], T.IntegerType())
    + _fields(shirt_columns("home") + shirt_columns("visiting"), T.IntegerType())
    + _fields(player_id_columns("home") + player_id_columns("visiting"), T.StringType())
    + _fields(
        [
            "server_id",
            "server_name",
            "serve_eval_code",
            "receiver_id",
            "receiver_name",
            "receive_eval_code",
            "setter_id",
            "setter_name",
            "set_code",
            "set_type",
            "attacker_id",
            "attacker_name",
            "attack_code",
            "attack_eval_code",
        ],
        T.StringType(),
    )
    + _fields(
        ["home_score_start_of_point", "visiting_score_start_of_point", "score_diff"],
        T.IntegerType(),
    )
    + _fields(["point_won_by"], T.StringType())
    + _fields(["prev_point_won", *SITUATION_FLAGS], T.BooleanType())
)

# Columns of the older form of the table, without names, outcome and lag.
BASIC_COLUMNS = [
    name
    for name in SERVE_RECEIVE.fieldNames()
    if not name.endswith("_name") and name not in ("point_won_by", "prev_point_won")
]

GAME_TAGS = T.StructType(
    [
        T.StructField("game_number", T.IntegerType()),
        T.StructField("period", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

# A season row also names the file it comes from, which is what identifies a game.
SEASON = T.StructType([*SERVE_RECEIVE.fields, *GAME_TAGS.fields, T.StructField("source_file", T.StringType())])

# One row for each file that was read: the load that has its rows, and why it has none.
LOADED_FILES = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("load", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)
