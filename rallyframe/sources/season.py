"""A folder of match files as one season table, and the stored form of that table."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rallyframe.functions.columns import canonical_id
from rallyframe.operators.points import serve_receive
from rallyframe.schema import LOADED_FILES, SEASON, SERVE_RECEIVE, player_id_columns
from rallyframe.sources.scout import (
    FILE,
    Paths,
    file_name,
    game_tags,
    has_splittable_files,
    list_files,
    read_lines,
    touches,
)
from rallyframe.session import settle

# Files of one load: their paths pass through the driver, as the file listing itself does.
FILES_PER_LOAD = 10_000

NO_POINT = "no serve-receive point"


@dataclass(frozen=True)
class SeasonLoad:
    """``rows``: the season table. ``rejects``: (source_file, file_name, reason)."""

    rows: DataFrame
    rejects: DataFrame


def tagged_files(spark: SparkSession, paths: Paths) -> DataFrame:
    """(source_file, file_name, game_number, period, split, reject_reason) of the files under some paths."""
    tags = game_tags(F.col("file_name"))
    return list_files(spark, paths).select(
        FILE, "file_name", *[column.alias(name) for name, column in tags.items()]
    )


def extract(lines: DataFrame, splittable: bool, focus_team_id: str, focus_team_name: str) -> DataFrame:
    """Serve-receive rows with the file as key, from lines of match files."""
    return serve_receive(
        touches(lines, splittable),
        focus_team_id,
        focus_team_name,
        names_unique=True,
        bounded_games=not splittable,
    )


def tag_games(rows: DataFrame) -> DataFrame:
    """Season rows: game number, period and split from the file name."""
    tags = game_tags(file_name(F.col(FILE)))
    del tags["reject_reason"]
    return rows.withColumns(tags).select(*SEASON.fieldNames())


def extract_match(
    spark: SparkSession,
    path: str,
    focus_team_id: str,
    focus_team_name: str,
    game_number: int = 1,
    period: str = "match",
    split: str = "all",
) -> DataFrame:
    """Serve-receive rows of a single file whose name says nothing about game, period and split."""
    splittable = has_splittable_files(spark, path)
    rows = extract(read_lines(spark, path), splittable, focus_team_id, focus_team_name)
    tags = {"game_number": F.lit(game_number), "period": F.lit(period), "split": F.lit(split)}
    return rows.withColumns(tags).select(*SEASON.fieldNames())


def load_season(spark: SparkSession, paths: Paths, focus_team_id: str, focus_team_name: str) -> SeasonLoad:
    """All games under some paths with game number, period and split from the file names.

    Files with other names and files without a usable point are listed with the reason. No usable file at all
    is an error.
    """
    files = tagged_files(spark, paths)
    accepted = files.where(F.col("reject_reason").isNull())
    if accepted.isEmpty():
        raise ValueError(f"no match files with a usable name in {paths}")
    lines = read_lines(spark, paths, named_games_only=True)
    rows = extract(lines, has_splittable_files(spark, paths), focus_team_id, focus_team_name)
    empty = accepted.join(rows.select(FILE).distinct(), FILE, "left_anti").select(
        FILE, "file_name", F.lit(NO_POINT).alias("reason")
    )
    misnamed = files.where(F.col("reject_reason").isNotNull()).select(
        FILE, "file_name", F.col("reject_reason").alias("reason")
    )
    return SeasonLoad(tag_games(rows), misnamed.unionByName(empty))


def combine(*pieces: DataFrame) -> DataFrame:
    """One season table from pieces loaded apart."""
    season = pieces[0]
    for piece in pieces[1:]:
        season = season.unionByName(piece)
    return season


def new_rows(candidates: DataFrame, stored: DataFrame, key: str = FILE) -> DataFrame:
    """Rows whose key is not stored yet."""
    return candidates.join(stored.select(key).distinct(), key, "left_anti")


def _parts(path: str) -> tuple[str, str]:
    return f"{path}/rows", f"{path}/files"


def write_season(rows: DataFrame, files: DataFrame, path: str) -> None:
    """Store one load: the season ``rows`` of some ``files`` (source_file, file_name, reason), null for files with rows.

    Rows are appended first and the files after them, each with the number of the load. Readers take a file's rows from
    its last listed load, so a load replaces the files it holds and no others, one that broke off counts for nothing,
    and running it twice gives the same table. Each period's rows are gathered into few files, and a period that is
    too large for a task is split.
    """
    stored, listed = _parts(path)
    load = F.lit(time.time_ns())
    rows.select(*SEASON.fieldNames(), load.alias("load")).hint("rebalance", "period").write.mode("append").partitionBy(
        "period"
    ).parquet(stored)
    files.select(FILE, "file_name", load.alias("load"), "reason").write.mode("append").parquet(listed)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, file_name, load, reason): the last load of every file of a stored season; no rows if there is none."""
    try:
        listed = spark.read.schema(LOADED_FILES).parquet(_parts(path)[1])
    except AnalysisException:
        return spark.createDataFrame([], LOADED_FILES)
    last = F.max_by(F.struct("file_name", "load", "reason"), "load").alias("last")
    return listed.groupBy(FILE).agg(last).select(FILE, "last.*")


def read_season(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; a filter on the period reads only its folder."""
    schema = StructType([*SEASON.fields, StructField("load", LongType())])
    rows = spark.read.schema(schema).parquet(_parts(path)[0])
    current = read_files(spark, path).where(F.col("reason").isNull()).select(FILE, "load")
    return rows.join(current, [FILE, "load"], "left_semi").select(*SEASON.fieldNames())


def _batches(paths: Iterator[str]) -> Iterator[list[str]]:
    while batch := list(islice(paths, FILES_PER_LOAD)):
        yield batch


def update_season(
    spark: SparkSession, folder: str, path: str, focus_team_id: str, focus_team_name: str, force: bool = False
) -> SeasonLoad:
    """Extract the files that are not stored yet (all of them with ``force``); the stored table and its rejects.

    A file is known by its path: several files of one game are all kept, and files without a usable point are
    remembered and not read again. Which files are new is decided from the listing; they are read in loads of at most
    FILES_PER_LOAD.
    """
    files = tagged_files(spark, folder).where(F.col("reject_reason").isNull())
    if files.isEmpty():
        raise ValueError(f"no match files with a usable name in {folder}")
    fresh = files if force else new_rows(files, read_files(spark, path), FILE)
    paths = (row[0] for row in settle(fresh.select(FILE)).toLocalIterator())
    for batch in _batches(paths):
        loaded = load_season(spark, batch, focus_team_id, focus_team_name)
        rows = settle(loaded.rows)
        read = tagged_files(spark, batch).join(rows.select(FILE).distinct().withColumn("full", F.lit(True)), FILE, "left")
        reason = F.when(F.col("full").isNull(), F.lit(NO_POINT)).alias("reason")
        write_season(rows, read.select(FILE, "file_name", reason), path)
    misnamed = tagged_files(spark, folder).where(F.col("reject_reason").isNotNull())
    empty = read_files(spark, path).where(F.col("reason").isNotNull())
    rejects = misnamed.select(FILE, "file_name", F.col("reject_reason").alias("reason")).unionByName(
        empty.select(FILE, "file_name", "reason")
    )
    return SeasonLoad(read_season(spark, path), rejects)


def write_csv(rows: DataFrame, path: str) -> None:
    """Text form with a header; NULL is written as NA."""
    rows.write.mode("overwrite").csv(path, header=True, nullValue="NA")


def canonical_ids(rows: DataFrame) -> DataFrame:
    """Every player and team id in canonical form, for rows that were not read from match files here."""
    ids = [name for name in rows.columns if name.endswith("_id") and name != "point_id"]
    ids += player_id_columns("home") + player_id_columns("visiting")
    return rows.withColumns({name: canonical_id(F.col(name)) for name in ids})


def read_csv(spark: SparkSession, path: str, tagged: bool = False) -> DataFrame:
    """Rows of ``write_csv``, or of a file with the same columns whose ids were written as numbers."""
    schema = SEASON if tagged else SERVE_RECEIVE
    return canonical_ids(spark.read.schema(schema).csv(path, header=True, nullValue="NA"))
