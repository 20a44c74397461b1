"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "rallyframe") -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        named = tempfile.mkdtemp(prefix="rallyframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder of this application below the shared one."""
    return f"{shared_folder(spark)}/rallyframe-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


# Rows of a file whose readers do much for each row: rows pack so small that by bytes one task would read them all.
FILE_ROWS = 20_000


def settle(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Fitted tables (dictionaries, profiles, class probabilities) go through here: their lineage
    ends, a lost executor costs a re-read and not a re-fit, and Catalyst knows their exact size, so
    a later join broadcasts them only when they are below its threshold. The folder carries the
    application id, so it can be removed once the application is over. With ``file_rows``, no file has more rows,
    and the readers share the files out over all cores.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
