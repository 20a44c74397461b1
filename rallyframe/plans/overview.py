"""First look at a season or match table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.groups import (
    counts,
    distinct_values,
    flag_rates,
    rows_and_members,
    value_counts,
)
from rallyframe.schema import SITUATION_FLAGS


def points_by_period(season: DataFrame) -> DataFrame:
    """Points and games per period and split."""
    return rows_and_members(season, ["period", "split"], "game_number", "points", "games")


def points_by_set(match: DataFrame) -> DataFrame:
    return value_counts(match, "set_number", by="value")


def situation_rates(rows: DataFrame) -> DataFrame:
    return flag_rates(rows, SITUATION_FLAGS)


def receive_codes(rows: DataFrame) -> DataFrame:
    return value_counts(rows, "receive_eval_code")


def attacker_counts(rows: DataFrame) -> DataFrame:
    return value_counts(rows.where(~F.col("no_attack")), "attacker_id")


def attack_counts(rows: DataFrame) -> DataFrame:
    """Rows per attacker and attack code."""
    return counts(rows, ["attacker_id", "attack_code"])


def setter_positions(rows: DataFrame, side: str) -> DataFrame:
    return value_counts(rows.where(~F.col("no_attack")), f"{side}_setter_position", by="value")


def sets_present(rows: DataFrame) -> DataFrame:
    return distinct_values(rows, "set_number")


def first_rows(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.orderBy("game_number", "set_number", "point_id").limit(n)
