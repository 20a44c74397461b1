"""A season table that follows a folder: each match file is extracted once.

The file source keeps which files it has read in its checkpoint, so files need not be compared with the
stored table, and a batch that is repeated after a failure replaces its own files.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rallyframe.session import settle
from rallyframe.sources.scout import FILE, file_name, has_usable_name, number_lines, place_lines
from rallyframe.sources.season import NO_POINT, extract, tag_games, write_season


def start(
    spark: SparkSession,
    folder: str,
    path: str,
    checkpoint: str,
    focus_team_id: str,
    focus_team_name: str,
    files_per_batch: int = 1000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the query; ``trigger`` holds the arguments of the stream writer's trigger."""
    raw = (
        spark.readStream.option("pathGlobFilter", "*.dvw")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
    )
    placed = place_lines(raw).where(has_usable_name(F.col(FILE)))

    def store(batch: DataFrame, _: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            splittable = not batch.where(F.col("block").isNotNull()).isEmpty()
            rows = extract(number_lines(batch), splittable, focus_team_id, focus_team_name)
            games = settle(tag_games(rows))
            full = games.select(FILE).distinct().withColumn("full", F.lit(True))
            read = batch.select(FILE).distinct().join(full, FILE, "left")
            reason = F.when(F.col("full").isNull(), F.lit(NO_POINT)).alias("reason")
            write_season(games, read.select(FILE, file_name(F.col(FILE)).alias("file_name"), reason), path)
        finally:
            batch.unpersist()

    return (
        placed.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_available(
    spark: SparkSession, folder: str, path: str, checkpoint: str, focus_team_id: str, focus_team_name: str
) -> None:
    """Extract what has arrived since the last run, then stop."""
    query = start(spark, folder, path, checkpoint, focus_team_id, focus_team_name)
    try:
        query.awaitTermination()
    finally:
        query.stop()
