"""Scoring lines while they are coded: previous rows from keyed state, then the batch's own expressions.

Lines may come late, out of order and more than once. A line waits in the state until the watermark has passed its time:
then no earlier one can come any more, and it is released in order with what went before it. Groups share a fixed number
of buckets, so that a call of Python and a read of state serve the lines of many groups. Model, masking and
predictability are the columns that batch scoring uses, joined to the stream.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from rallyframe.models.frequency import FrequencyModel
from rallyframe.operators import evaluation as E
from rallyframe.session import settle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PART = "least bigint, part string"
RELEASED = "at bigint, position bigint, actor string, slot string, prev_actor string, recent array<string>"
LINE = pa.schema(
    [("group", pa.int64()), ("at", pa.int64()), ("position", pa.int64()), ("actor", pa.string()), ("slot", pa.string())]
)
LAST = pa.schema([*LINE.remove(4), ("slots", pa.list_(pa.string()))])

# Waiting lines of one trigger and day are stored together: what is released then leaves the others untouched.
DAY = 86_400_000_000
# Groups share so many buckets; a stream keeps its number for life, as its state is dealt by it.
BUCKETS = 256
# Released lines that go back to Spark at a time.
OUT_LINES = 50_000
# A model measured at up to so many bytes goes along to every task.
MODEL_BYTES = 1 << 20


class _InOrder(StatefulProcessor):
    """Two states a bucket: lines that wait, and each group's last released line with the slots before it."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", PART, "lines binary")
        self.last = handle.getValueState("last", "groups binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [part for part in rows if len(part)]
        if frames:
            lines = pa.concat_tables([_lines(part) for part in frames])
            days = lines["at"].to_numpy() // DAY
            now = f"{time.time_ns():020d}"  # parts are read in the order in which they came
            for day in np.unique(days):
                self._store(lines.filter(pa.array(days == day)), f"{now} {day}")
            self.handle.registerTimer(_after(int(lines["at"].to_numpy().min()), timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def _store(self, lines: pa.Table, part: str) -> int:
        least = int(lines["at"].to_numpy().min())
        self.waiting.updateValue((least, part), (_packed(lines),))
        return least

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        parts = sorted((tuple(part) for part in self.waiting.keys()), key=lambda x: x[1])
        due, later = [], [least for least, _ in parts if least > now * 1000]
        for least, part in parts:
            if least > now * 1000:
                continue
            lines = _unpacked(self.waiting.getValue((least, part))[0])
            self.waiting.removeKey((least, part))
            ready = lines["at"].to_numpy() <= now * 1000
            due.append(lines.filter(pa.array(ready)))
            if not ready.all():
                later.append(self._store(lines.filter(pa.array(~ready)), part))
        if later:
            self.handle.registerTimer(_after(min(later), now))
        if due:
            yield from self._released(key, pa.concat_tables(due))

    def _released(self, key, lines: pa.Table) -> Iterator[pd.DataFrame]:
        """The lines in order, each once, with what the state knows of their groups."""
        keys = [lines[name].to_numpy() for name in ("position", "at", "group")]
        order = np.lexsort(keys)  # equal ones stay in the order in which they came, and the last one counts
        again = np.ones(len(order), bool)
        for values in keys:
            again[:-1] &= values[order][1:] == values[order][:-1]
        again[-1:] = False
        columns = [column.to_pylist() for column in lines.take(pa.array(order[~again])).columns]
        stored = self.last.get()
        table = _unpacked(stored[0]) if stored is not None else LAST.empty_table()
        touched = pc.is_in(table["group"], pa.array(np.unique(keys[2])))
        known = {row[0]: row[1:] for row in zip(*(column.to_pylist() for column in table.filter(touched).columns))}
        out, group = [], None
        for own, *line in zip(*columns):
            if own != group:
                if group is not None:
                    known[group] = (at, position, actor, slots)
                group = own
                at, position, actor, slots = known.get(own, (None, None, None, []))
            if at is not None and tuple(line[:2]) <= (at, position):
                continue  # a line that was released before and has come again
            out.append((*key, group, *line, actor, slots))
            at, position, actor = line[:3]
            slots = [*slots, line[3]][-self.size :]
            if len(out) == OUT_LINES:
                yield _frame(out)
                out = []
        if group is not None:
            known[group] = (at, position, actor, slots)
        if out:
            yield _frame(out)
        rows = [pa.array(x, kind) for x, kind in zip(zip(*((k, *v) for k, v in known.items())), LAST.types)]
        table = pa.concat_tables([table.filter(pc.invert(touched)), pa.Table.from_arrays(rows, schema=LAST)])
        self.last.update((_packed(table),))

    def close(self) -> None:
        pass


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(stored) -> pa.Table:
    return pa.ipc.open_stream(bytes(stored)).read_all()


def _lines(part: pd.DataFrame) -> pa.Table:
    numbers = [pa.array(part[name].astype("int64")) for name in ("group", "at", "position")]
    texts = [pa.array(part[name], pa.string(), from_pandas=True) for name in ("actor", "slot")]
    return pa.Table.from_arrays([*numbers, *texts], schema=LINE)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["bucket", "group", "at", "position", "actor", "slot", "prev_actor", "recent"]
    return pd.DataFrame(rows, columns=names)


def _after(micros: int, now: int) -> int:
    """The first millisecond at or after a time, and after the present watermark."""
    return max(-(-micros // 1000), now + 1)


def live_history(
    lines: DataFrame,
    group: str,
    position: str,
    actor: str,
    slot: Column,
    time: str,
    delay: str,
    size: int = 6,
    buckets: int = BUCKETS,
) -> DataFrame:
    """group, position, actor, ts, slot, prev_actor and recent (the last ``size`` slots) of each line, once and in order.

    ``lines`` is a stream with a bigint ``group`` and ``position`` and a time; lines of one group are ordered by (time,
    position). A line is released when the watermark, ``delay`` behind the latest time, has passed it. One that comes
    later than that is dropped by Spark, a repeated one here. State holds the lines of the delay and of one trigger, so
    bound a trigger by files or offsets. ``prev_actor`` is NULL on a group's first line. Groups are dealt over ``buckets``,
    the most tasks that can share the work; a task holds the lines of one bucket that become due in one trigger, and
    reads and writes the last lines of all its groups then.
    """
    known = F.col(group).cast("bigint")
    stream = lines.select(
        # lines without a group are one, in a bucket of its own
        F.when(known.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(known), F.lit(buckets))).cast("int").alias("bucket"),
        F.coalesce(known, F.lit(0)).alias("group"),
        F.col(time).cast("timestamp").alias("ts"),
        F.unix_micros(F.col(time).cast("timestamp")).alias("at"),
        F.col(position).cast("bigint").alias("position"),
        F.col(actor).cast("string").alias("actor"),
        slot.cast("string").alias("slot"),
    ).withWatermark("ts", delay)
    schema = StructType.fromDDL(f"bucket int, `group` bigint, {RELEASED}")
    released = stream.groupBy("bucket").transformWithStateInPandas(_InOrder(size), schema, "Append", "EventTime")
    return released.select(
        F.when(F.col("bucket") >= 0, F.col("group")).alias(group),
        F.col("position").alias(position),
        F.col("actor").alias(actor),
        F.timestamp_micros("at").alias(time),
        "slot",
        "prev_actor",
        "recent",
    )


def _measured(model: FrequencyModel) -> FrequencyModel:
    """The model with its table stored, and joined by its measured size.

    By size Catalyst would choose wrongly: it sees the files of a trigger, not the lines that the state releases. A
    trigger without new lines has size 0, and all that it releases would be collected by the driver and broadcast.
    """
    table = settle(model.table)
    texts = sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) for key in model.keys)
    n_bytes = table.agg(F.coalesce(F.sum(texts + 8 * len(model.classes)), F.lit(0))).first()[0]
    return replace(model, table=table.hint("broadcast" if n_bytes <= MODEL_BYTES else "merge"))


def live_scores(history: DataFrame, model: FrequencyModel, actor: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Masked probabilities and predictability of every released line that has a previous one and a known key.

    A small model is broadcast; with a larger one, the lines are dealt out and sorted by its keys. Lines never are.
    """
    names = list(classes or model.classes)
    rows = history.where(F.col("prev_actor").isNotNull()).withColumnRenamed("prev_actor", model.keys[0])
    known = _measured(model).transform(rows).where(F.col("probability").isNotNull())
    masked = E.mask_to_available(known, names, F.col("recent"))
    return E.add_predictability(masked, actor, len(names))


def start(scores: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append scored lines to Parquet files under ``path``; keyed state lives in RocksDB."""
    spark: SparkSession = scores.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            scores.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
