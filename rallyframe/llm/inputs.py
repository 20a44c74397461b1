"""What all operators ask of their input: a document id, a text, and columns to carry along."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Texts go to Python in Arrow batches of about so many bytes; Spark's own value fills an executor's off-heap memory.
BATCH_SETTING, BATCH_BYTES, SPARK_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20, 64 << 20

#: Allocator settings of glibc and Arrow. A Python worker lives on between tasks; with these what a task
#: has freed goes back to the system, and is not kept beside the executor's heap.
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(256 << 10),
    "MALLOC_TRIM_THRESHOLD_": str(1 << 20),
}


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has a value of its own."""
    if spark.conf.get(BATCH_SETTING).strip("b") == str(SPARK_BATCH_BYTES):
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application: their Python need not have it installed."""
    small_batches(spark)
    context = spark.sparkContext
    for name, value in WORKER_MEMORY.items():
        context.environment.setdefault(name, value)
    root = Path(__file__).resolve().parent.parent
    if getattr(context, "rallyframe_shipped", False) or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="rallyframe-code-")) / "rallyframe.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in root.rglob("*.py"):
            archive.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(path))
    context.rallyframe_shipped = True


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def documents(docs: DataFrame, carry: Iterable[str] = (), results: Iterable[str] = ()) -> DataFrame:
    """`doc_id`, `text` as bytes, and the carried columns as one struct `carried`.

    Other columns are left out, so their names cannot clash; a carried column with the name of a result is left out too.
    """
    ship(docs.sparkSession)
    taken = {name.lower() for name in results}
    carry = [name for name in carry if name.lower() not in taken]
    packed = [F.struct(*[column(name) for name in carry]).alias("carried")] if carry else []
    return docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"), *packed)


def unpacked(rows: DataFrame) -> DataFrame:
    """The struct `carried`, if there is one, as columns again, after the results."""
    if "carried" not in rows.columns:
        return rows
    rest = [column(name) for name in rows.columns if name != "carried"]
    names = rows.schema["carried"].dataType.names
    return rows.select(*rest, *[F.col("carried").getField(name).alias(name) for name in names])


def result_schema(source: DataFrame, results: str) -> StructType:
    """The type of rows that have the id, `results` and, if `source` carries columns, those."""
    schema = StructType([source.schema["doc_id"], *StructType.fromDDL(results).fields])
    return schema.add(source.schema["carried"]) if "carried" in source.columns else schema


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of all texts): one pass that moves two numbers."""
    row = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return int(row[0]), int(row[1])
