"""The operators on the driver tables.

Events stand in for touches: user = game, day = set, event_id = line order; view = serve, click =
reception, signup = set, purchase = attack, error = end of a point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions import columns as C
from rallyframe.functions import probability as P
from rallyframe.models.boosted import BoostedModel, fit_boosted_model
from rallyframe.models.forest import fit_forest_model
from rallyframe.models.frequency import fit_frequency_model, fit_sparse_frequency_model, frequency_rows
from rallyframe.operators import evaluation as E
from rallyframe.operators import groups as G
from rallyframe.operators import labels as L
from rallyframe.operators.calibration import brier, calibration_error, confidence_cells, reliability
from rallyframe.operators.features import (
    COURT_COLUMNS,
    FeatureBuilder,
    add_gated_lag,
    add_ungated_lag,
    base_features,
)
from rallyframe.operators.lookups import attach_role, ids_with_several_names, names_by_id
from rallyframe.operators.ordered import Ordered, previous, recent, row_number
from rallyframe.operators.points import serve_receive
from rallyframe.operators.profiles import add_profile, fit_profile
from rallyframe.operators.updating import add_counts_so_far, add_updated
from rallyframe.plans.match import ROW_KEY, analyse_match
from rallyframe.plans.season import model_rows
from rallyframe.schema import MATCH_MODEL, MODEL_FEATURES, SEASON
from rallyframe.session import FILE_ROWS, scratch, settle
from rallyframe.sources.scout import (
    FILE,
    decode,
    first_by_shirt,
    game_tags,
    player,
    player_map,
    segment,
    tag_sections,
)
from rallyframe.sources.season import combine, new_rows, read_csv, read_season, write_csv, write_season
from rallyframe.streaming import live_scoring
from rallyframe.streaming.live_scoring import live_history, live_scores

Query = Callable[[SparkSession, str], DataFrame]

TRAIN_UNTIL = "2024-01-25"
DICTIONARY_UNTIL = "2024-01-02"
COURT_VALUE = 20
PRIORITY_NUMBER = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5}
DAY_PERIODS = ["pre", "conf1", "conf2"]
PRIOR_STRENGTH = 10.0
RELIABILITY_BINS = 8
LIVE_CUT_DAYS = 8
LIVE_FILES = 8
FOREST_MODEL = {"trees": 40, "max_depth": 9, "subsample": 0.8, "seed": 42}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").withColumn("d", F.to_date("ts"))


def _before(day: str) -> Column:
    return F.col("ts") < F.lit(day).cast("timestamp_ntz")


def _day(name: str = "d") -> Column:
    return F.col(name).cast("string").alias(name)


def _r(column: Column | str) -> Column:
    return F.round(column, 6)


# --- points ---------------------------------------------------------------------------------


def q01_first_touch(spark: SparkSession, sf: str) -> DataFrame:
    first = G.first_per_group(
        _events(spark, sf), ["user_id", "d", "event_type"], "event_id", ["event_id", "value"]
    )
    return first.select("user_id", _day(), "event_type", "event_id", "value")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    kind, event, value = F.col("event_type"), F.col("event_id"), F.col("value")
    roles = {
        "serve": G.Role(kind == "view", {"serve_id": event, "serve_value": value}),
        "reception": G.Role(kind == "click", {"receive_id": event, "receive_value": value}),
        "set": G.Role(kind == "signup", {"set_id": event, "set_value": value}),
        "attack": G.Role(kind == "purchase", {"attack_id": event, "attack_value": value}),
        "outcome": G.Role(kind == "error", {"outcome_id": event}),
    }
    return G.first_by_role(
        _events(spark, sf), ["user_id", "d"], ["event_id"], roles, required=["serve", "reception"]
    )


def q02_points(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).select(
        "user_id",
        _day(),
        "serve_id",
        "serve_value",
        "receive_id",
        "receive_value",
        "set_id",
        "attack_id",
        "outcome_id",
        F.col("set_id").isNull().alias("no_set"),
        F.col("attack_id").isNull().alias("no_attack"),
    )


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with customer and supplier and the nation of each."""
    nation = _table(spark, sf, "nation")
    lines = _table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"
    )
    orders = _table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    rows = attach_role(
        rows,
        _table(spark, sf, "customer"),
        "o_custkey",
        "c_custkey",
        {"c_name": "customer_name", "c_nationkey": "customer_nationkey", "c_acctbal": "customer_balance"},
    )
    rows = attach_role(
        rows,
        _table(spark, sf, "supplier"),
        "l_suppkey",
        "s_suppkey",
        {"s_name": "supplier_name", "s_nationkey": "supplier_nationkey", "s_acctbal": "supplier_balance"},
    )
    rows = attach_role(rows, nation, "customer_nationkey", "n_nationkey", {"n_name": "customer_nation"})
    return attach_role(rows, nation, "supplier_nationkey", "n_nationkey", {"n_name": "supplier_nation"})


def q03_role_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _order_lines(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "customer_name",
        "customer_nation",
        "supplier_name",
        "supplier_nation",
    )


def q04_score_diff(spark: SparkSession, sf: str) -> DataFrame:
    side = F.col("user_id") % 3
    return _points(spark, sf).select(
        "user_id",
        _day(),
        _r(
            C.score_difference(side == 0, side == 1, F.col("serve_value"), F.col("receive_value"))
        ).alias("score_diff"),
    )


def _band(value: Column) -> Column:
    """A code for a value; NULL stays NULL."""
    return (
        F.when(value < 10, "#")
        .when(value < 20, "+")
        .when(value < 30, "!")
        .when(value < 40, "-")
        .when(value < 60, "/")
        .when(value >= 60, "=")
    )


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    serve, receive = _band(F.col("set_value")), _band(F.col("attack_value"))
    return _points(spark, sf).select(
        "user_id",
        _day(),
        (serve == "#").alias("is_ace"),
        C.overpass(receive, "/", "=").alias("is_overpass"),
        C.one_of(receive, ["-", "!"]).alias("out_of_system"),
        F.col("set_id").isNull().alias("no_set"),
        F.col("attack_id").isNull().alias("no_attack"),
    )


def q05_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf)


def q05_flag_rates(spark: SparkSession, sf: str) -> DataFrame:
    flags = ["is_ace", "is_overpass", "out_of_system", "no_set", "no_attack"]
    return G.flag_rates(_flags(spark, sf), flags).select("flag", "n", _r("rate").alias("rate"))


def q06_side_select(spark: SparkSession, sf: str) -> DataFrame:
    customer_receives = F.col("l_returnflag") == "R"
    pairs = {
        "nation": ("customer_nation", "supplier_nation"),
        "key": ("o_custkey", "l_suppkey"),
        "balance": ("customer_balance", "supplier_balance"),
    }
    picked = []
    for name, (customer, supplier) in pairs.items():
        customer, supplier = F.col(customer), F.col(supplier)
        picked.append(C.side_value(customer_receives, customer, supplier).alias(f"recv_{name}"))
        picked.append(C.side_value(customer_receives, supplier, customer).alias(f"opp_{name}"))
    return _order_lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", *picked)


# --- lags -----------------------------------------------------------------------------------


def _by_user(df: DataFrame) -> Ordered:
    return Ordered.by_position(df, ["user_id"], "event_id")


def q07_lag_ungated(spark: SparkSession, sf: str) -> DataFrame:
    rows = _by_user(_events(spark, sf).select("event_id", "user_id", "event_type"))
    lagged = add_ungated_lag(
        rows.scan(before=previous("event_type")), "event_type", "event_type", F.lit("purchase")
    )
    return lagged.df.select(
        "event_id",
        "user_id",
        (F.col("before.event_type") == "purchase").alias("prev_is_purchase"),
        "prev_actor",
        "prev_won",
    )


def q08_lag_gated(spark: SparkSession, sf: str) -> DataFrame:
    rows = (
        _by_user(_events(spark, sf).select("event_id", "user_id", "event_type", "d"))
        .scan(point_id=row_number())
        .map(lambda df: df.where(F.col("event_type") != "error"))
    )
    lagged = add_gated_lag(rows, ["d"], "point_id", "event_type", "event_type", F.lit("purchase"))
    return lagged.df.select(
        "event_id", "user_id", _day(), "point_id", "is_consecutive", "prev_actor", "prev_won"
    )


# --- counts, shares, dictionaries -----------------------------------------------------------


def q09_share(spark: SparkSession, sf: str) -> DataFrame:
    counted = G.counts(_events(spark, sf), ["user_id", "event_type"])
    return G.shares(counted, ["user_id"]).select("user_id", "event_type", "n", _r("share").alias("share"))


def q10_top_code(spark: SparkSession, sf: str) -> DataFrame:
    counted = G.counts(_events(spark, sf), ["user_id", "event_type"])
    top = G.top_member(G.shares(counted, ["user_id"]), ["user_id"], "event_type", "share")
    return top.select("user_id", "event_type", _r("share").alias("share"))


def q11_label_encode(spark: SparkSession, sf: str) -> DataFrame:
    return L.fit_dictionary(_table(spark, sf, "part"), "p_brand").select("p_brand", "idx")


def _user_text() -> Column:
    return C.canonical_id(F.col("user_id"))


def _user_dictionary(events: DataFrame) -> DataFrame:
    early = events.where(_before(DICTIONARY_UNTIL))
    return L.fit_dictionary(early.select(_user_text().alias("label")), "label")


def q12_encode_unseen(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    encoded = L.encode(events, _user_dictionary(events), C.label_text(_user_text()), "user_enc", "label")
    return encoded.select("event_id", "user_id", "user_enc")


def _joint_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    lines = _table(spark, sf, "lineitem")
    columns = {name: F.col(name) for name in ("l_returnflag", "l_linestatus")}
    pooled = L.pool_labels(lines, columns, "label").union(_table(spark, sf, "orders").select("o_orderstatus"))
    return L.fit_dictionary(pooled, "label")


def q13_joint_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return _joint_dictionary(spark, sf).select("label", "idx")


def q13_joint_encode(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = _joint_dictionary(spark, sf)
    rows = _table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"
    )
    for name in ("l_returnflag", "l_linestatus"):
        rows = L.encode(rows, dictionary, C.label_text(F.col(name)), f"{name}_enc", "label")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag_enc", "l_linestatus_enc")


def q14_target_encode(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    encoded = L.encode(events, _user_dictionary(events), _user_text(), "target", "label", unseen=None)
    return encoded.na.drop(subset=["target"]).select("event_id", "user_id", "target")


def _coded_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "orders").withColumn(
        "priority_number", C.lookup(F.col("o_orderpriority"), PRIORITY_NUMBER)
    )


def q15_code_map(spark: SparkSession, sf: str) -> DataFrame:
    return _coded_orders(spark, sf).select("o_orderkey", "o_orderpriority", "priority_number")


def q15_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    return G.unmapped_codes(_coded_orders(spark, sf), "o_orderpriority", "priority_number")


def q16_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    types = G.value_counts(_events(spark, sf), "event_type")
    states = G.value_counts(_table(spark, sf, "orders"), "o_orderstatus", by="value")
    return types.select(F.lit("event_type").alias("source"), F.col("event_type").alias("value"), "n").unionByName(
        states.select(F.lit("o_orderstatus").alias("source"), F.col("o_orderstatus").alias("value"), "n")
    )


def q16_distinct_days(spark: SparkSession, sf: str) -> DataFrame:
    return G.distinct_values(_events(spark, sf), "d").select(_day())


def _split() -> Column:
    return F.when(_before(TRAIN_UNTIL), F.lit("train")).otherwise(F.lit("test"))


def q17_period_split(spark: SparkSession, sf: str) -> DataFrame:
    week = F.floor(F.datediff("d", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    tagged = _events(spark, sf).select(week.alias("week"), _split().alias("split"), "user_id")
    return G.rows_and_members(tagged, ["week", "split"], "user_id", "n_rows", "n_users")


def q18_split_by_set(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("d")
    part = (
        F.when(day.isin(list(range(1, 21))), F.lit("train"))
        .when(day == 21, F.lit("test"))
        .when(day == 22, F.lit("hold_out"))
    )
    tagged = _events(spark, sf).select("event_id", part.alias("part"))
    return tagged.where(F.col("part").isNotNull())


def q19_attack_profile(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf).select("event_id", "user_id", "event_type", "ts")
    profile = fit_profile(events.where(_before(TRAIN_UNTIL)), "user_id", "event_type", "top_enc")
    return add_profile(events, profile, "user_id", "top_enc").select("event_id", "user_id", "top_enc")


def q20_unseen(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    known = events.where(_before(DICTIONARY_UNTIL))
    return G.unseen_labels(events, known, "user_id")


def q21_union(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf).select("event_id", "ts", "value")
    train, test = events.where(_before(TRAIN_UNTIL)), events.where(~_before(TRAIN_UNTIL))
    return (
        train.withColumn("split", F.lit("train"))
        .unionByName(test.withColumn("split", F.lit("test")))
        .select("event_id", "split", "value")
    )


def q21_label_union(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    return G.label_union(
        events.where(_before(DICTIONARY_UNTIL)), events.where(~_before(TRAIN_UNTIL)), "user_id"
    )


# --- class probabilities --------------------------------------------------------------------


def _with_history(spark: SparkSession, sf: str) -> DataFrame:
    """Events that have a previous one, with its type and six court slots: the types of the previous six
    events, NULL for those of too little value."""
    slot = F.when(F.col("value") >= COURT_VALUE, F.col("event_type"))
    events = _events(spark, sf).select(
        "event_id", "user_id", "event_type", "value", "ts", "d", slot.alias("slot")
    )
    scanned = _by_user(events).scan(before=previous("event_type"), last_six=recent(6, "slot")).df
    return scanned.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "ts",
        "d",
        F.col("before.event_type").alias("prev_type"),
        F.col("last_six.slot").alias("on_court"),
    ).where(F.col("prev_type").isNotNull())


def _train_and_all(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and all rows, from one stored table: fitting and scoring both read it."""
    history = settle(_with_history(spark, sf))
    return history.where(_before(TRAIN_UNTIL)), history


def q22_frequency_model(spark: SparkSession, sf: str) -> DataFrame:
    train = _with_history(spark, sf).where(_before(TRAIN_UNTIL))
    return frequency_rows(train, ["prev_type"], "event_type").select(
        "prev_type", "event_type", "n", _r("p").alias("p")
    )


def _masked(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Events with masked probabilities, and the number of classes."""
    train, history = _train_and_all(spark, sf)
    model = fit_frequency_model(train, ["prev_type"], "event_type")
    known = model.transform(history).where(F.col("probability").isNotNull())
    return E.mask_to_available(known, model.classes, F.col("on_court")), len(model.classes)


def q23_masked(spark: SparkSession, sf: str) -> DataFrame:
    listed = E.list_probabilities(_masked(spark, sf)[0], ["event_id"])
    return listed.select("event_id", "class", _r("p").alias("p"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("d")
    masked, n_classes = _masked(spark, sf)
    return E.add_predictability(masked, "event_type", n_classes).withColumns(
        {
            "rotation": (F.col("user_id") % 6 + 1).cast("int"),
            "period": F.when(day <= 10, "pre").when(day <= 20, "conf1").otherwise("conf2"),
        }
    )


def _in_system() -> Column:
    return F.col("value") >= COURT_VALUE


def q24_scored(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(
        "event_id",
        _r("pred_entropy").alias("pred_entropy"),
        "top_predicted",
        "prediction_correct",
        "chose_non_top",
    )


def q25_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = E.summarise(_scored(spark, sf), _in_system())
    return E.listed_metrics(summary).select("metric", _r("value").alias("value"))


def q26_by_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return E.by_rotation(_scored(spark, sf), "rotation", 1, 7).select(
        "rotation", _r("mean_entropy").alias("mean_entropy"), _r("non_top_rate").alias("non_top_rate")
    )


def q27_cross_period(spark: SparkSession, sf: str) -> DataFrame:
    summary = E.summarise(_scored(spark, sf), _in_system(), ["period"])
    wide = E.compare_periods(summary, "period", DAY_PERIODS)
    return wide.select("metric", *[_r(name).alias(name) for name in DAY_PERIODS])


def q27_rotation_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return E.by_rotation(_scored(spark, sf), "rotation", 1, 7, ["period"]).select(
        "period", "rotation", _r("mean_entropy").alias("mean_entropy"), _r("non_top_rate").alias("non_top_rate")
    )


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion_cells(_scored(spark, sf).where(~_before(TRAIN_UNTIL)), "event_type", "top_predicted")


def q28_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.class_report(_cells(spark, sf)).select(
        C.player_label(F.col("label")).alias("name"),
        _r("precision").alias("precision"),
        _r("recall").alias("recall"),
        _r("f1").alias("f1"),
        "support",
    )


def q28_averages(spark: SparkSession, sf: str) -> DataFrame:
    averages = E.report_averages(E.class_report(_cells(spark, sf)))
    rounded = [name for name in averages.columns if name != "support"]
    return averages.select(*[_r(name).alias(name) for name in rounded], "support")


def q29_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion_matrix(settle(_cells(spark, sf)))


def q30_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    test = _scored(spark, sf).where(~_before(TRAIN_UNTIL))
    return E.log_loss(test, "event_type").select(_r("log_loss").alias("log_loss"), "n_rows", "n_clipped")


def q31_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return E.probability_patterns(_masked(spark, sf)[0])


def q31_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    masked, _ = _masked(spark, sf)
    checks = E.probability_diagnostics(masked, ["event_id"], F.array_distinct("on_court"))
    return checks.select(
        "event_id", _r("row_sum").alias("row_sum"), "n_positive", F.concat_ws(",", "available").alias("available")
    )


# The fitted model of the last session and folder: three queries read it, one of them fits it.
_fitted: dict[tuple[str, str], tuple[BoostedModel, DataFrame]] = {}


def _boosted(spark: SparkSession, sf: str) -> tuple[BoostedModel, DataFrame]:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = _fit_boosted(spark, sf)
    return _fitted[key]


def _fit_boosted(spark: SparkSession, sf: str) -> tuple[BoostedModel, DataFrame]:
    train, history = _train_and_all(spark, sf)
    previous_types = L.fit_dictionary(train.select(F.col("prev_type").alias("label")), "label")
    targets = L.fit_dictionary(train.select(F.col("event_type").alias("label")), "label")
    rows = L.encode(history, previous_types, F.col("prev_type"), "prev_enc", "label")
    rows = L.encode(rows, targets, F.col("event_type"), "target", "label", unseen=None)
    features = ["prev_enc", "n_on_court", "rotation", "day"]
    rows = settle(
        rows.withColumns(
            {
                "n_on_court": F.size(F.array_compact("on_court")),
                "rotation": F.col("user_id") % 6 + 1,
                "day": F.dayofmonth("d"),
            }
        )
        .na.drop(subset=[*features, "target"])
        .select("event_id", "event_type", "value", "ts", "on_court", "target", *features),
        FILE_ROWS,
    )
    model = fit_boosted_model(
        rows.where(_before(TRAIN_UNTIL)),
        features,
        "target",
        L.class_list(targets, "label"),
        **MATCH_MODEL,
    )
    return model, rows


def q32_mllib(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = _boosted(spark, sf)
    masked = E.mask_to_available(model.transform(rows), model.classes, F.col("on_court"))
    scored = E.add_predictability(masked, "event_type", len(model.classes))
    return scored.select(
        "event_id", _r("pred_entropy").alias("pred_entropy"), "top_predicted", "prediction_correct"
    )


def q32_importance(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = _boosted(spark, sf)
    return model.importances(rows)


def q32_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What holds whatever the trees are: masked sums, mass off court, entropies, the two outcome flags, importances."""
    model, rows = _boosted(spark, sf)
    masked = E.mask_to_available(model.transform(rows), model.classes, F.col("on_court"))
    scored = E.add_predictability(masked, "event_type", len(model.classes))
    total = P.total(F.col("probability"))
    off_court = F.exists(
        F.arrays_zip(F.col("classes").alias("class"), F.col("probability").alias("p")),
        lambda pair: (pair["p"] > 0) & ~F.coalesce(F.array_contains("on_court", pair["class"]), F.lit(False)),
    )

    def bad(test: Column, name: str) -> Column:
        return F.count_if(test).alias(name)

    most = F.log(F.lit(float(len(model.classes))))
    counted = scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        bad((F.abs(total) > 1e-9) & (F.abs(total - 1) > 1e-9), "n_bad_sum"),
        bad(off_court, "n_off_court"),
        bad((F.col("pred_entropy") < -1e-9) | (F.col("pred_entropy") > most + 1e-9), "n_bad_entropy"),
        bad(F.col("prediction_correct") == F.col("chose_non_top"), "n_bad_flags"),
    )
    importance = model.importances(rows).agg(_r(F.sum("importance")).alias("importance_sum"))
    return counted.withColumn("importance_sum", importance.scalar())


# --- coded lines ----------------------------------------------------------------------------


def _coded_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as match file lines; errors become point lines."""
    event, kind = F.col("event_id"), F.col("event_type")
    letter = C.lookup(kind, {"view": "S", "click": "R", "signup": "E", "purchase": "A"})
    side = F.when(event % 2 == 0, F.lit("*")).otherwise(F.lit("a"))
    shirt = F.lpad((F.col("user_id") % 100).cast("string"), 2, "0")
    evaluation = F.substring(F.lit("#+!-/="), (F.floor("value") % 6 + 1).cast("int"), F.lit(1))
    digit = (event % 10).cast("string")
    combination = (
        F.when(kind == "signup", F.concat(F.lit("K"), digit))
        .when((kind == "purchase") & (event % 7 != 0), F.concat(F.lit("X"), digit))
        .otherwise(F.lit("~~"))
    )
    target = F.when(
        kind == "signup", F.substring(F.lit("FBCPS"), (event % 5 + 1).cast("int"), F.lit(1))
    ).otherwise(F.lit("~"))
    touch = F.concat(side, shirt, letter, F.lit("M"), evaluation, combination, target, F.lit("15A"))
    point = F.concat(
        side,
        F.lit("p"),
        F.lpad((F.floor("value") % 30).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((event % 30).cast("string"), 2, "0"),
    )
    blank = F.lit("")
    court = [((event + slot) % 100).cast("string") for slot in range(12)]
    line = F.concat_ws(
        ";",
        F.when(kind == "error", point).otherwise(touch),
        blank,
        blank,
        blank,
        *[F.lit("-1-1")] * 3,
        blank,
        F.dayofmonth("d").cast("string"),
        (event % 6 + 1).cast("string"),
        (F.col("user_id") % 6 + 1).cast("string"),
        F.lit("1"),
        F.lit("905"),
        blank,
        *court,
        blank,
    )
    return _events(spark, sf).select("event_id", "user_id", line.alias("value"))


def q33_decode(spark: SparkSession, sf: str) -> DataFrame:
    return decode(_coded_lines(spark, sf)).select(
        "event_id",
        "side",
        "shirt",
        "skill",
        "evaluation_code",
        "set_code",
        "set_type",
        "attack_code",
        "set_number",
        "home_setter_position",
        "visiting_setter_position",
        "home_points",
        "visiting_points",
        "home_p1",
        "home_p6",
        "visiting_p1",
        "visiting_p6",
    )


def q34_segment(spark: SparkSession, sf: str) -> DataFrame:
    lines = decode(_coded_lines(spark, sf)).withColumn("line_no", F.col("event_id"))
    return segment(_by_user(lines)).df.select(
        "event_id", "user_id", "point_id", "phase", "home_team_score", "visiting_team_score"
    )


def q35_incremental(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf).select("event_id", "user_id", "ts")
    stored = events.where(_before(DICTIONARY_UNTIL))
    return new_rows(events, stored, "user_id").select("event_id", "user_id")


# --- small reports --------------------------------------------------------------------------


def q36_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    dictionary = _user_dictionary(events)
    late = events.where(~_before(TRAIN_UNTIL))
    encoded = L.encode(late, dictionary, _user_text(), "target", "label", unseen=None)
    return L.class_counts(encoded, dictionary, "target", "label")


def q37_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).orderBy("user_id", "event_id").limit(5).select("event_id", "user_id", "event_type")


def q38_one_point(spark: SparkSession, sf: str) -> DataFrame:
    """Unmasked class probabilities of the first test event."""
    train, history = _train_and_all(spark, sf)
    model = fit_frequency_model(train, ["prev_type"], "event_type")
    first = history.where(~_before(TRAIN_UNTIL)).orderBy("event_id").limit(1)
    return E.list_probabilities(model.transform(first), ["event_id"]).select(
        "event_id", "class", _r("p").alias("p")
    )


# --- files, rosters, features ---------------------------------------------------------------


def q39_file_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Game, period, split and reject reason of file names made from orders."""
    order = F.col("o_orderkey")
    split = F.when(order % 5 == 0, F.lit("test")).otherwise(F.lit("train"))
    name = (
        F.when(order % 7 == 0, F.lit("X-Y.dvw"))
        .when(order % 11 == 0, F.lit("xx_pre_train_vs_Z.dvw"))
        .otherwise(
            F.concat(
                F.lpad((order % 30).cast("string"), 2, "0"),
                F.lit("_"),
                F.col("o_orderstatus"),
                F.lit("_"),
                split,
                F.lit("_vs_"),
                F.col("o_orderpriority"),
                F.lit(".dvw"),
            )
        )
    )
    tags = [column.alias(tag) for tag, column in game_tags(F.col("name")).items()]
    return _table(spark, sf, "orders").select("o_orderkey", name.alias("name")).select("o_orderkey", *tags)


def q40_roster_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as the rosters of 25 games; orders look up a side and a shirt."""
    customer = F.col("c_custkey")
    listed = _table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias(FILE),
        F.when(customer % 2 == 0, F.lit("*")).otherwise(F.lit("a")).alias("side"),
        (F.floor(customer / 2) % 100).cast("int").alias("shirt"),
        customer.cast("string").alias("player_id"),
        F.col("c_name").alias("player_name"),
        customer.alias("line_no"),
    )
    rosters = settle(player_map(first_by_shirt(listed, ["player_id", "player_name"])))
    order = F.col("o_orderkey")
    touched = _table(spark, sf, "orders").select(
        "o_orderkey",
        (order % 25).cast("string").alias(FILE),
        F.when(order % 3 == 0, F.lit("*")).otherwise(F.lit("a")).alias("side"),
        (F.col("o_custkey") % 130).cast("int").alias("shirt"),
    )
    found = player(F.col("side"), F.col("shirt"))
    return touched.join(rosters, FILE, "left").select(
        "o_orderkey", found["player_id"].alias("player_id"), found["player_name"].alias("player_name")
    )


def q41_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Errors as section headers; every other event gets its section and line number."""
    header = F.concat(F.lit("[3SECTION"), (F.col("event_id") % 5).cast("string"), F.lit("]"))
    lines = _events(spark, sf).select(
        "event_id",
        "user_id",
        F.when(F.col("event_type") == "error", header).otherwise(F.col("event_type")).alias("value"),
    )
    return tag_sections(_by_user(lines)).df.select("event_id", "user_id", "section", "line_no")


def q42_one_name(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as players: brand = game, size = id, several names per id."""
    return names_by_id(_table(spark, sf, "part"), ["p_brand"], "p_size", "p_name", "p_partkey")


def q42_several_names(spark: SparkSession, sf: str) -> DataFrame:
    return ids_with_several_names(_table(spark, sf, "part"), ["p_brand"], "p_size", "p_name")


def _season_like(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the columns the feature builder reads: user = game, day = set, place in the game = point."""
    event, user = F.col("event_id"), F.col("user_id")
    numbered = _by_user(
        _events(spark, sf).select("event_id", "user_id", "event_type", "value", "ts", "d")
    ).scan(point_id=row_number()).df
    receives = F.when(F.col("value") >= COURT_VALUE, F.lit("A")).otherwise(F.lit("B"))
    home = F.when(user % 2 == 0, F.lit("A")).otherwise(F.lit("B"))

    def opposite(team: Column) -> Column:
        return F.when(team == "A", F.lit("B")).otherwise(F.lit("A"))

    players = {}
    for slot in range(1, 7):
        players[f"home_player_id{slot}"] = (-((user + slot) % 20)).cast("string")
        players[f"visiting_player_id{slot}"] = (-(100 + (event + slot) % 15)).cast("string")
    code = F.substring(F.lit("#+!-/=?"), (F.floor("value") % 7 + 1).cast("int"), F.lit(1))
    return numbered.withColumns(
        {
            "game_number": user,
            "set_number": F.dayofmonth("d"),
            "period": F.when(user % 3 == 0, F.lit("pre")).otherwise(F.lit("conf1")),
            "receiving_team": receives,
            "serving_team": opposite(receives),
            "home_team": home,
            "visiting_team": opposite(home),
            "home_setter_position": (event % 6 + 1).cast("int"),
            "visiting_setter_position": (user % 6 + 1).cast("int"),
            "receive_eval_code": code,
            "server_id": (-(event % 40)).cast("string"),
            "attacker_id": (-(event % 12)).cast("string"),
            "attack_code": F.col("event_type"),
            "point_won_by": F.when(event % 4 == 0, F.lit("A")).otherwise(F.lit("B")),
            "score_diff": (event % 9).cast("int"),
            "no_attack": F.col("event_type") == "error",
            "prev_point_won": F.lit(None).cast("boolean"),
            **players,
        }
    )


def q43_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature builder fitted on the training days, per period, and applied to all rows."""
    rows = settle(base_features(_season_like(spark, sf), "A"))
    builder = FeatureBuilder("A", ["period"], include_attacker_profile=True)
    return builder.fit_rows(rows.where(_before(TRAIN_UNTIL))).encode(rows).select(
        "event_id",
        "period",
        "pass_quality",
        "receiving_rotation",
        "server_encoded",
        *[f"{name}_enc" for name in COURT_COLUMNS],
        "prev_point_won",
        "prev_attacker_enc",
        "target",
        "player_top_attack_enc",
    )


def q32_match(spark: SparkSession, sf: str) -> DataFrame:
    """Single-match analysis: days 1-5 as the sets of one match, builder features, full settings; invariants by set."""
    match = _season_like(spark, sf).where(F.dayofmonth("d") <= 5).withColumns(
        {"game_number": F.lit(1), "point_id": F.col("event_id"), "split": F.lit("train")}
    )
    analysis = analyse_match(match, "A")
    total = P.total(F.col("probability"))
    most = F.log(F.lit(float(len(analysis.model.classes))))
    flags = F.col("prediction_correct") == F.col("chose_non_top")
    counted = analysis.scored.groupBy("set_number").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(*ROW_KEY).alias("n_points"),
        F.count_if((F.abs(total) > 1e-9) & (F.abs(total - 1) > 1e-9)).alias("n_bad_sum"),
        F.count_if((F.col("pred_entropy") < -1e-9) | (F.col("pred_entropy") > most + 1e-9)).alias("n_bad_entropy"),
        F.count_if(flags).alias("n_bad_flags"),
    )
    listed = analysis.importances().agg(F.count("feature").alias("n"), _r(F.sum("importance")).alias("total")).first()
    return counted.withColumns({"n_features": F.lit(listed["n"]), "importance_sum": F.lit(listed["total"])})


def _touches(spark: SparkSession, sf: str) -> DataFrame:
    """The coded lines as touches of two teams: user = game; a shirt's player has several spellings of a name."""
    lines = decode(_coded_lines(spark, sf)).withColumn("line_no", F.col("event_id"))
    rows = segment(_by_user(lines)).df
    is_home, is_touch = F.col("side") == "*", F.col("is_touch")
    team = C.side_value(is_home, F.lit("A"), F.lit("B"))
    number = C.side_value(is_home, F.lit(1000), F.lit(2000)) + F.col("shirt")
    name = F.concat(F.lit("P"), number.cast("string"), F.lit("/"), (F.col("line_no") % 3).cast("string"))
    players = {
        f"{who}_player_id{slot}": F.when(shirt % 9 != 0, (-(first + shirt)).cast("string"))
        for who, first in (("home", 1000), ("visiting", 2000))
        for slot in range(1, 7)
        for shirt in [F.col(f"{who}_p{slot}")]
    }
    return rows.withColumns(
        {
            "home_team": F.lit("A"),
            "visiting_team": F.lit("B"),
            "home_team_id": F.lit("1"),
            "visiting_team_id": F.lit("2"),
            "team": F.when(is_touch, team),
            "player_id": F.when(is_touch, (-number).cast("string")),
            "player_name": F.when(is_touch, name),
            "point_won_by": F.when(F.col("is_point"), team),
            **players,
        }
    )


def q44_serve_receive(spark: SparkSession, sf: str) -> DataFrame:
    """Lines decoded, segmented and assembled into the 58 columns of a point."""
    return serve_receive(_touches(spark, sf), "1", "A", game="user_id")


def q45_season_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Points of three periods written as CSV and Parquet to the shared folder, read back and put together."""
    points = q44_serve_receive(spark, sf)
    game = F.col("user_id")
    tagged = points.withColumns(
        {
            "game_number": game.cast("int"),
            "period": F.when(game % 3 == 0, F.lit("pre")).when(game % 3 == 1, F.lit("conf1")).otherwise(F.lit("conf2")),
            "split": F.when(game % 5 == 0, F.lit("test")).otherwise(F.lit("train")),
            FILE: F.concat(F.lit("game "), game.cast("string")),
        }
    ).select(*SEASON.fieldNames())
    season = settle(tagged)
    folder = scratch(spark)
    write_csv(season.where("period = 'pre'"), f"{folder}/csv")
    late = season.where("period <> 'pre'")
    files = late.select(FILE, F.col(FILE).alias("file_name"), F.lit(None).cast("string").alias("reason")).distinct()
    write_season(late, files, f"{folder}/season")
    both = combine(read_csv(spark, f"{folder}/csv", tagged=True), read_season(spark, f"{folder}/season"))
    return both.groupBy("period", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("game_number").alias("n_games"),
        F.count("setter_id").alias("n_set"),
        F.sum("score_diff").alias("lead"),
        F.count_if(F.col("prev_point_won")).alias("n_after_won"),
    )


# --- updating, calibration, live scoring ----------------------------------------------------


def q46_bayes_updated(spark: SparkSession, sf: str) -> DataFrame:
    """The frequency model as a prior, updated event by event with the types the user has had so far."""
    train, history = _train_and_all(spark, sf)
    model = fit_frequency_model(train, ["prev_type"], "event_type")
    events = _by_user(_events(spark, sf).select("event_id", "user_id", "event_type"))
    seen = add_counts_so_far(events, "event_type", model.classes).df.select("event_id", "seen")
    known = model.transform(history.join(seen, "event_id")).where(F.col("probability").isNotNull())
    posterior = add_updated(known, PRIOR_STRENGTH, len(model.classes))
    masked = E.mask_to_available(posterior, model.classes, F.col("on_court"))
    scored = E.add_predictability(masked, "event_type", len(model.classes))
    chosen = P.probability_of(F.col("probability"), F.col("classes"), F.col("event_type"))
    return scored.select(
        "event_id",
        F.aggregate("seen", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_seen"),
        _r(chosen).alias("p_actual"),
        _r("pred_entropy").alias("pred_entropy"),
        "top_predicted",
    )


def _reliability(scored: DataFrame) -> DataFrame:
    cells = confidence_cells(scored, F.array_max("probability"), F.col("prediction_correct"), ["period"])
    return reliability(cells, RELIABILITY_BINS, ["period"])


def q47_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of the top pick against how often it was right, in bins of equal mass by period."""
    return _reliability(_scored(spark, sf)).select(
        "period", "bin", "n", _r("mean_confidence").alias("mean_confidence"), _r("hit_rate").alias("hit_rate")
    )


def q47_brier(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score and calibration error by period."""
    scored = settle(_scored(spark, sf))
    score = brier(F.col("probability"), F.col("classes"), F.col("event_type"))
    means = scored.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("brier"))
    both = means.join(calibration_error(_reliability(scored), ["period"]), "period")
    return both.select("period", "n", _r("brier").alias("brier"), _r("calibration_error").alias("calibration_error"))


def q48_live_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Events scored as a stream that gets them in cuts of some days, out of order, and some of them twice.

    Each event lies in the cut of its time plus up to a day; every seventh comes again one cut later. The delay covers
    a cut and that day. A last line, far ahead, lets the watermark pass all events.
    """
    events = _events(spark, sf).select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    model = fit_frequency_model(_train_and_all(spark, sf)[0], ["prev_type"], "event_type")
    late = F.pmod(F.xxhash64("event_id"), F.lit(86_400))
    cut = ((F.unix_seconds("ts") + late) / F.lit(LIVE_CUT_DAYS * 86_400)).cast("bigint").alias("cut")
    placed = settle(events.select("*", cut).union(events.where("event_id % 7 = 0").select("*", cut + 1)))
    folder = scratch(spark)
    for (number,) in placed.select("cut").distinct().orderBy("cut").collect():  # some cuts of a month
        placed.where(F.col("cut") == number).drop("cut").write.mode("append").parquet(f"{folder}/lines")
    ahead = events.limit(1).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"),
        F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"),
        (F.col("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"),
    )
    ahead.write.mode("append").parquet(f"{folder}/lines")
    lines = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", LIVE_FILES).parquet(f"{folder}/lines")
    slot = F.when(F.col("value") >= COURT_VALUE, F.col("event_type"))
    history = live_history(
        lines, "user_id", "event_id", "event_type", slot, "ts", f"{LIVE_CUT_DAYS + 2} days", size=6
    )
    scores = live_scores(history, model, "event_type").select(
        "event_id", "prev_type", "pred_entropy", "top_predicted", "prediction_correct"
    )
    query = live_scoring.start(scores, f"{folder}/scores", f"{folder}/state")
    query.awaitTermination()
    return spark.read.schema(scores.schema).parquet(f"{folder}/scores").select(
        "event_id", "prev_type", _r("pred_entropy").alias("pred_entropy"), "top_predicted", "prediction_correct"
    )


# --- all classes at once, and very many classes ---------------------------------------------


def q49_forest(spark: SparkSession, sf: str) -> DataFrame:
    """A forest on all features of the builder against the frequency model of the previous attacker, on later days."""
    base = settle(base_features(_season_like(spark, sf), "A"))
    fitted = FeatureBuilder("A", []).fit_rows(base.where(_before(TRAIN_UNTIL)))
    rows = settle(model_rows(fitted.encode(base), MODEL_FEATURES))
    train, test = rows.where(_before(TRAIN_UNTIL)), rows.where(~_before(TRAIN_UNTIL))
    classes = L.class_list(fitted.targets, "label")
    forest = fit_forest_model(train, MODEL_FEATURES, "target", classes, **FOREST_MODEL)
    scored = settle(forest.transform(test))
    by_previous = fit_frequency_model(train, ["prev_attacker_id"], "attacker_id").transform(test)
    plain = E.log_loss(by_previous.where(F.col("probability").isNotNull()), "attacker_id").first()
    sums = F.abs(P.total(F.col("probability")) - 1) > 1e-9
    loss = E.log_loss(scored, "attacker_id").select("log_loss").first()["log_loss"]
    return scored.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(sums).alias("n_bad_sum")).select(
        F.lit(train.count()).alias("n_train"),
        "n_test",
        "n_bad_sum",
        F.lit(len(MODEL_FEATURES)).alias("n_features"),
        F.lit(len(classes)).alias("n_classes"),
        _r(F.lit(plain["log_loss"])).alias("frequency_log_loss"),
        F.lit(loss < plain["log_loss"]).alias("forest_is_better"),
    )


def q50_many_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Who acts next, with every user a class: shares by event type, available are the day's last six users."""
    events = _events(spark, sf).select("event_id", "event_type", "ts", "d", F.col("user_id").cast("string").alias("user"))
    scanned = Ordered.by_position(events, ["d"], "event_id").scan(last_six=recent(6, "user")).df
    rows = settle(scanned.withColumn("on_court", F.col("last_six.user")).drop("last_six"))
    model = fit_sparse_frequency_model(rows.where(_before(TRAIN_UNTIL)), ["event_type"], "user")
    known = model.available_probabilities(rows, ["event_id"], "on_court").where(F.col("probability").isNotNull())
    scored = E.add_sparse_predictability(known, "user", F.col("on_court"))
    return scored.select(
        "event_id",
        _r("pred_entropy").alias("pred_entropy"),
        "top_predicted",
        "prediction_correct",
        _r("p_actual").alias("p_actual"),
    )


def registered() -> dict[str, Query]:
    """Every query by name."""
    return {name: query for name, query in sorted(globals().items()) if name[0] == "q" and name[1:3].isdigit()}
