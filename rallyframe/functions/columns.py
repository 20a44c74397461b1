"""Scalar expressions over codes, ids, flags and two-sided columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyframe.schema import LABEL_OF_MISSING


def lookup(code: Column, table: Mapping) -> Column:
    """Value of ``code`` in a small fixed table; NULL when it is not listed."""
    entries = [F.lit(item) for item in chain.from_iterable(table.items())]
    return F.create_map(*entries)[code]


def side_value(is_home: Column, home: Column, visiting: Column) -> Column:
    """The home column when ``is_home`` holds; a NULL test counts as not home."""
    return F.when(is_home, home).otherwise(visiting)


def canonical_id(value: Column) -> Column:
    """Integer text of an id however it was typed: ``-9``, ``-9.0`` and ``' -9'`` agree."""
    text = F.trim(value.cast("string"))
    whole = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    return F.coalesce(whole.cast("string"), text)


def label_text(value: Column) -> Column:
    """Text fed to a dictionary; a missing value is a label of its own."""
    return F.coalesce(value.cast("string"), F.lit(LABEL_OF_MISSING))


def never_null(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def one_of(code: Column, choices: Sequence[str]) -> Column:
    """Membership that is FALSE, not NULL, for a missing code."""
    return never_null(code.isin(list(choices)))


def overpass(code: Column, straight_over: str, lost: str) -> Column:
    """Ball sent straight over or lost; stays NULL when there is no code."""
    return (code == straight_over) | (code.isNotNull() & (code == lost))


def score_difference(home_is_focus: Column, visiting_is_focus: Column, home: Column, visiting: Column) -> Column:
    """Lead of the focus side; NULL when neither side is the focus."""
    return F.when(home_is_focus, home - visiting).when(visiting_is_focus, visiting - home)


def indicator(flag: Column) -> Column:
    """1.0 for TRUE, 0.0 for FALSE and NULL."""
    return F.coalesce(flag.cast("double"), F.lit(0.0))


def percent(value: Column, places: int = 1) -> Column:
    """Display text of a rate, such as ``41.7%``."""
    return F.concat(F.format_number(value * 100, places), F.lit("%"))


def player_label(player_id: Column) -> Column:
    return F.concat(F.lit("player_"), player_id)
