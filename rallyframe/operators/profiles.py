"""What each actor does most often, learned from training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.groups import counts, shares, top_member
from rallyframe.operators.labels import encode, fit_dictionary
from rallyframe.session import settle


def top_codes(train: DataFrame, actor: str, code: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent code per actor with its share; the smaller code wins a tie."""
    shared = shares(counts(train, [*keys, actor, code]), [*keys, actor])
    return top_member(shared, [*keys, actor], code, "share")


def fit_profile(train: DataFrame, actor: str, code: str, index: str, keys: Sequence[str] = ()) -> DataFrame:
    """Profile (keys, actor, code, share, index): the top code and its place among the top codes."""
    top = settle(top_codes(train, actor, code, keys))
    ranked = fit_dictionary(top, code, keys, "__place")
    return settle(encode(top, ranked, F.col(code), index, code, keys, "__place", unseen=None))


def add_profile(df: DataFrame, profile: DataFrame, actor: str, index: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add the profile index of the row's actor; actors without a profile get NULL."""
    return df.join(profile.select(*keys, actor, index), [*keys, actor], "left")
