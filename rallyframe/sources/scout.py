"""Coded match files to touch rows.

A match file is text in sections; the last section lists every coded touch in order. Files are read
line by line and never as one value, so a file of any size is spread over tasks. Lines are ordered
by ``seq`` inside their file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions.columns import canonical_id, lookup, side_value
from rallyframe.operators.ordered import (
    Ordered,
    count_before,
    last_before,
    last_so_far,
    row_number,
)
from rallyframe.schema import COURT, SKILLS, shirt_columns
from rallyframe.session import settle

FILE = "source_file"

# One folder or file, or a list of them.
Paths = str | list[str]

# --- fixed values of the file format ---------------------------------------------------------
SECTION_MARK = "[3"
HOME, VISITING = "*", "a"
BLANK_CODES = ["", "~", " ", "~~", "~ ", " ~", "  "]
TOUCH_PATTERN = r"^[*a][0-9]{2}[SREABDF]"
POINT_PATTERN = r"^[*a]p[0-9]+:[0-9]+"
FIELD_SET_NUMBER = 8
FIELD_SETTER_POSITION = {"home": 9, "visiting": 10}
FIELD_FIRST_SHIRT = 14  # six of the home side, then six of the visiting side
# --- end of fixed values ---------------------------------------------------------------------


def _field(fields: Column, place: int) -> Column:
    """Text of a field, NULL when the line is too short or the field empty."""
    return F.nullif(F.get(fields, place), F.lit(""))


def _number(fields: Column, place: int) -> Column:
    return F.get(fields, place).try_cast("int")


def _code_part(code: Column, start: int, length: int) -> Column:
    """Characters of a touch code; blanks and filler characters are NULL."""
    part = F.substring(code, start, length)
    return F.when(~part.isin(BLANK_CODES), part)


# --- files -----------------------------------------------------------------------------------


def list_files(spark: SparkSession, paths: Paths, pattern: str = "*.dvw") -> DataFrame:
    """(source_file, file_name, n_bytes) of the match files under some paths; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(paths)
        .select(
            F.col("_metadata.file_path").alias(FILE),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("length").alias("n_bytes"),
        )
    )


def has_splittable_files(spark: SparkSession, paths: Paths, pattern: str = "*.dvw") -> bool:
    """Whether any file may be read by more than one task.

    Spark never cuts a file below its open cost (4 MB unless set), so without such files every file
    is a group of a bounded number of lines.
    """
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(cost)
    return not list_files(spark, paths, pattern).where(F.col("n_bytes") > limit).isEmpty()


def file_name(path: Column) -> Column:
    """Last part of a file path; paths come with blanks and the like encoded."""
    return F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "[^/]*$", 0)


def game_tags(name: Column) -> dict[str, Column]:
    """Game number, period and split from ``{game}_{period}_{split}_vs_{opponent}.dvw``, and what is wrong."""
    parts = F.split(F.regexp_replace(name, r"\.dvw", ""), "_")
    game = F.get(parts, 0).try_cast("int")
    return {
        "game_number": game,
        "period": F.get(parts, 1),
        "split": F.get(parts, 2),
        "reject_reason": F.when(F.size(parts) < 3, F.lit("name has fewer than three parts")).when(
            game.isNull(), F.lit("game number is not an integer")
        ),
    }


def has_usable_name(path: Column) -> Column:
    return game_tags(file_name(path))["reject_reason"].isNull()


def place_lines(raw: DataFrame) -> DataFrame:
    """(source_file, block, value) of text rows; ``block`` is the split a line was read in, NULL for whole files."""
    metadata = F.col("_metadata")
    return raw.select(
        metadata["file_path"].alias(FILE),
        F.when(metadata["file_block_length"] < metadata["file_size"], metadata["file_block_start"]).alias("block"),
        "value",
    )


def number_lines(placed: DataFrame) -> DataFrame:
    """Add ``seq``, which rises along the lines of a split."""
    return placed.withColumn("seq", F.monotonically_increasing_id())


def read_lines(
    spark: SparkSession, paths: Paths, pattern: str = "*.dvw", named_games_only: bool = False
) -> DataFrame:
    """(source_file, block, value, seq): every line. Files left out by name are not opened."""
    placed = place_lines(spark.read.option("pathGlobFilter", pattern).text(paths))
    if named_games_only:
        placed = placed.where(has_usable_name(F.col(FILE)))
    return number_lines(placed)


def order_lines(lines: DataFrame, splittable: bool) -> Ordered:
    """Lines of ``read_lines`` in file order; without splittable files a file is a bounded group."""
    if splittable:
        return Ordered.by_block(lines, [FILE], ["block", "seq"], F.col("block"))
    return Ordered.bounded(lines, [FILE], ["seq"])


def tag_sections(ordered: Ordered) -> Ordered:
    """Add the section name and the line number to every line, and drop header and empty lines."""
    is_header = F.col("value").startswith(SECTION_MARK)
    name = F.when(is_header, F.regexp_extract("value", r"^\[3([^\]]*)", 1))
    return ordered.scan(section=last_so_far(name), line_no=row_number()).map(
        lambda df: df.where(~is_header & (F.col("value") != "")).withColumn("line_no", F.col("line_no").cast("int"))
    )


# --- header sections ------------------------------------------------------------------------


def _section(tagged: DataFrame, *names: str) -> DataFrame:
    return tagged.where(F.col("section").isin(*names)).withColumn("f", F.split("value", ";"))


def teams(tagged: DataFrame) -> DataFrame:
    """(source_file, home_team_id, home_team, visiting_team_id, visiting_team): the first and the last team line."""
    entry = F.struct(canonical_id(_field(F.col("f"), 0)).alias("id"), _field(F.col("f"), 1).alias("name"))
    return (
        _section(tagged, "TEAMS")
        .groupBy(FILE)
        .agg(F.min_by(entry, "line_no").alias("h"), F.max_by(entry, "line_no").alias("v"))
        .select(
            FILE,
            F.col("h.id").alias("home_team_id"),
            F.col("h.name").alias("home_team"),
            F.col("v.id").alias("visiting_team_id"),
            F.col("v.name").alias("visiting_team"),
        )
    )


def roster(tagged: DataFrame) -> DataFrame:
    """(source_file, side, shirt, player_id, player_name, starts, is_libero); a shirt listed twice keeps its first line."""
    f = F.col("f")
    first, last = _field(f, 10), _field(f, 9)
    listed = _section(tagged, "PLAYERS-H", "PLAYERS-V").select(
        FILE,
        "line_no",
        F.when(F.col("section") == "PLAYERS-H", F.lit(HOME)).otherwise(F.lit(VISITING)).alias("side"),
        _number(f, 1).alias("shirt"),
        canonical_id(_field(f, 8)).alias("player_id"),
        F.nullif(F.concat_ws(" ", first, last), F.lit("")).alias("player_name"),
        F.transform(F.slice(f, 4, 5), lambda slot: F.nullif(slot, F.lit(""))).alias("starts"),
        F.coalesce(F.get(f, 12) == "L", F.lit(False)).alias("is_libero"),
    )
    return first_by_shirt(listed, ["player_id", "player_name", "starts", "is_libero"])


def set_results(tagged: DataFrame) -> DataFrame:
    """(source_file, set_number, played, partials, final_score), one row per set line."""
    f = F.col("f")
    lines = _section(tagged, "SET").select(
        FILE,
        "line_no",
        (F.lower(F.get(f, 0)) == "true").alias("played"),
        F.transform(F.slice(f, 2, 3), F.trim).alias("partials"),
        _field(f, 4).alias("final_score"),
    )
    numbered = Ordered.by_position(lines, [FILE], "line_no").scan(set_number=row_number()).df
    return numbered.select(FILE, F.col("set_number").cast("int"), "played", "partials", "final_score")


def code_table(tagged: DataFrame) -> DataFrame:
    """(source_file, kind, code, zone, tempo, description, target): attack combinations and setter calls."""
    f = F.col("f")
    attack = F.col("section") == "ATTACKCOMBINATION"
    return _section(tagged, "ATTACKCOMBINATION", "SETTERCALL").select(
        FILE,
        F.when(attack, F.lit("attack")).otherwise(F.lit("set")).alias("kind"),
        F.get(f, 0).alias("code"),
        F.when(attack, _number(f, 1)).alias("zone"),
        F.when(attack, _field(f, 3)).alias("tempo"),
        F.when(attack, _field(f, 4)).otherwise(_field(f, 2)).alias("description"),
        F.when(attack, _field(f, 8)).alias("target"),
    )


def first_by_shirt(listed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per (source_file, side, shirt): the first by line; only shirts from 0 to 99 can be coded."""
    entry = F.struct(*columns)
    return (
        listed.where(F.col("shirt").between(0, 99))
        .groupBy(FILE, "side", "shirt")
        .agg(F.min_by(entry, "line_no").alias("e"))
        .select(FILE, "side", "shirt", "e.*")
    )


def player_map(shirts: DataFrame) -> DataFrame:
    """(source_file, players): a map from side and shirt (such as ``*7``) to player id and name.

    A map holds at most two sides of 100 shirts. Within a file an id keeps the first name listed for it,
    so a name found through the map is the same for every touch of that id.
    """
    entry = F.struct("side", "shirt", "player_id", "player_name")
    listed = shirts.groupBy(FILE).agg(F.array_sort(F.collect_list(entry)).alias("listed"))
    named = F.transform(
        "listed",
        lambda one: F.struct(
            F.concat(one["side"], one["shirt"].cast("string")).alias("key"),
            F.struct(
                one["player_id"].alias("player_id"),
                F.get(
                    F.filter("listed", lambda any_one: any_one["player_id"] == one["player_id"]), 0
                )["player_name"].alias("player_name"),
            ).alias("player"),
        ),
    )
    return listed.select(FILE, F.map_from_entries(named).alias("players"))


def player(side: Column, shirt: Column) -> Column:
    """Id and name of the player with a shirt, from the ``players`` map; NULL when it is not listed."""
    return F.element_at("players", F.concat(side, shirt.cast("string")))


def match_header(tagged: DataFrame) -> DataFrame:
    """One row per file: the teams and the player map."""
    return teams(tagged).join(player_map(roster(tagged)), FILE, "left")


# --- touches --------------------------------------------------------------------------------


def decode(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add the columns one line holds by itself; lines that are neither touch nor point get NULLs."""
    # Fields and scores are columns of their own so that each line is split once.
    fields, code, scores = F.col("__fields"), F.col("code"), F.col("__scores")
    is_touch, is_point = F.col("is_touch"), F.col("is_point")
    combination = _code_part(code, 7, 2)
    positions = {
        f"{side}_setter_position": _number(fields, place) for side, place in FIELD_SETTER_POSITION.items()
    }
    # One conversion over the twelve shirt fields: twelve of them would make the compiled method too large.
    on_court = F.transform(
        F.slice(fields, FIELD_FIRST_SHIRT + 1, 2 * len(COURT)), lambda shirt: shirt.try_cast("int")
    )
    names = shirt_columns("home") + shirt_columns("visiting")
    shirts = {name: F.get("__on_court", place) for place, name in enumerate(names)}
    return (
        lines.withColumn("__fields", F.split(value, ";"))
        .withColumn("code", F.get(fields, 0))
        .withColumns({"is_touch": code.rlike(TOUCH_PATTERN), "is_point": code.rlike(POINT_PATTERN)})
        .withColumn("__on_court", on_court)
        .withColumn("__scores", F.when(is_point, F.split(F.substring(code, 3, 10), ":")))
        .withColumns(
            {
                "side": F.when(is_touch | is_point, F.substring(code, 1, 1)),
                "shirt": F.when(is_touch, F.substring(code, 2, 2).try_cast("int")),
                "skill": F.when(is_touch, lookup(F.substring(code, 4, 1), SKILLS)),
                "set_number": _number(fields, FIELD_SET_NUMBER),
                "home_points": F.get(scores, 0).try_cast("int"),
                "visiting_points": F.get(scores, 1).try_cast("int"),
                **positions,
                **shirts,
            }
        )
        .withColumns(
            {
                "evaluation_code": F.when(is_touch, _code_part(code, 6, 1)),
                "set_code": F.when(F.col("skill") == "Set", combination),
                "set_type": F.when(F.col("skill") == "Set", _code_part(code, 9, 1)),
                "attack_code": F.when(F.col("skill") == "Attack", combination),
            }
        )
        .drop("code", "__fields", "__scores", "__on_court")
    )


def segment(touches: Ordered) -> Ordered:
    """Add point id, phase and the score at the start of the point.

    A point ends with its point line. Its id is one more than the point lines before it in the file.
    The receiving side is in its reception phase until the serving side touches the ball again.
    """
    line, side, is_point = F.col("line_no"), F.col("side"), F.col("is_point")
    is_serve = F.col("skill") == "Serve"
    later_touch = F.col("is_touch") & ~is_serve
    scanned = touches.scan(
        __points=count_before(is_point),
        __point=last_before(
            F.when(
                is_point,
                F.struct(
                    line.alias("line"), F.col("set_number").alias("set"), "home_points", "visiting_points"
                ),
            )
        ),
        __serve=last_so_far(F.when(is_serve, F.struct(line.alias("line"), side.alias("side")))),
        __home=last_so_far(F.when(later_touch & (side == HOME), line)),
        __visiting=last_so_far(F.when(later_touch & (side == VISITING), line)),
    )
    point, serve = F.col("__point"), F.col("__serve")
    served = serve["line"] > F.coalesce(point["line"], F.lit(0))
    returned = side_value(serve["side"] == HOME, F.col("__home"), F.col("__visiting")) > serve["line"]
    transition = (side == serve["side"]) | F.coalesce(returned, F.lit(False))
    same_set = point["set"] == F.col("set_number")
    return scanned.map(
        lambda df: df.withColumns(
            {
                "point_id": (F.col("__points") + 1).cast("int"),
                "phase": F.when(is_serve, F.lit("Serve")).when(
                    F.col("is_touch") & served,
                    F.when(transition, F.lit("Transition")).otherwise(F.lit("Reception")),
                ),
                "home_team_score": F.when(same_set, point["home_points"]).otherwise(F.lit(0)),
                "visiting_team_score": F.when(same_set, point["visiting_points"]).otherwise(F.lit(0)),
            }
        ).drop("__points", "__point", "__serve", "__home", "__visiting")
    )


def touches(lines: DataFrame, splittable: bool = True) -> DataFrame:
    """Every touch and point line, with teams and players resolved, from ``read_lines``.

    ``splittable`` = False says that no file was read in more than one split.
    """
    tagged = tag_sections(order_lines(lines, splittable))
    if splittable:  # every further step would read the files again, for the rows and for the blocks
        tagged = tagged.map(settle)
        header = settle(match_header(tagged.df))
    else:
        header = match_header(tagged.df)
    coded = tagged.map(
        lambda df: decode(df.where(F.col("section") == "SCOUT")).where(F.col("is_touch") | F.col("is_point"))
    )
    rows = segment(coded).df.join(header, FILE, "left")

    toucher = player(F.col("side"), F.col("shirt"))
    is_home = F.col("side") == HOME
    team = side_value(is_home, F.col("home_team"), F.col("visiting_team"))
    on_court = {
        f"{name}_player_id{slot}": player(F.lit(mark), F.col(f"{name}_p{slot}"))["player_id"]
        for name, mark in (("home", HOME), ("visiting", VISITING))
        for slot in COURT
    }
    return rows.withColumns(
        {
            "team": F.when(F.col("is_touch"), team),
            "player_id": toucher["player_id"],
            "player_name": toucher["player_name"],
            "point_won_by": F.when(F.col("is_point"), team),
            **on_court,
        }
    ).drop("players", "value", "section", "seq", "block", "is_touch", "is_point", "shirt", "home_points", "visiting_points")
