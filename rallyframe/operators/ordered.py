"""Running values over ordered rows, for groups of any size.

A plain window sends a whole group to one task. Here a group of more rows than a block is cut into
as many equal ranges of its positions as it has blocks' worth of rows: the window runs inside
(group, block), one small summary row per block is folded over the earlier blocks of the group, and
the folded value is joined back on (group, block) - the partitioning the window already has, so the
rows move once. Other groups have no block, and when there is no large group at all the adaptive
planner removes the whole summary branch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rallyframe.session import settle

BLOCK = "__block"
START, WIDTH = "__start", "__width"

# A group is cut when it holds more than this many rows, into blocks of so many on average.
BLOCK_ROWS = 1 << 20


@dataclass(frozen=True)
class Scan:
    """One running value."""

    kind: str
    value: Column | None = None
    size: int = 1


def row_number() -> Scan:
    """1-based place of the row in its group."""
    return Scan("row_number")


def sum_before(value: Column) -> Scan:
    """Sum over the earlier rows, 0 on the first."""
    return Scan("sum", value)


def count_before(condition: Column) -> Scan:
    """Number of earlier rows for which the condition holds."""
    return sum_before(F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def last_before(value: Column) -> Scan:
    """Latest non-NULL value among the earlier rows."""
    return Scan("last_before", value)


def last_so_far(value: Column) -> Scan:
    """Latest non-NULL value among the earlier rows and this one."""
    return Scan("last_so_far", value)


def previous(*columns: str) -> Scan:
    """The previous row as a struct of the named columns; NULL on the first row."""
    return last_before(F.struct(*columns))


def recent(size: int, *columns: str) -> Scan:
    """The ``size`` rows just before this one, oldest first, as structs of the named columns."""
    return Scan("recent", F.struct(*columns), size)


def _last_items(items: Column, size: int) -> Column:
    return F.when(F.size(items) <= size, items).otherwise(F.slice(items, -size, size))


class Ordered:
    """Rows with a grouping and a total order inside each group.

    ``by_position`` orders by one integer column that does not repeat within a group; group keys must
    not be NULL. ``by_block`` takes an ordered block column the data already has (NULL = not cut).
    ``bounded`` is for groups whose size cannot grow with the data.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], blocked: bool):
        self._df = df
        self.keys = list(keys)
        self.order = list(order)
        self.blocked = blocked

    @classmethod
    def bounded(cls, df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Ordered:
        return cls(df, keys, order, blocked=False)

    @classmethod
    def by_block(cls, df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> Ordered:
        return cls(df.withColumn(BLOCK, block), keys, order, blocked=True)

    @classmethod
    def by_position(cls, df: DataFrame, keys: Sequence[str], position: str, block_rows: int | None = None) -> Ordered:
        """The large groups, with first position and block width, are counted and stored first: their number and size
        are then known, and they are broadcast if small and joined by shuffle otherwise."""
        block_rows = block_rows or BLOCK_ROWS
        place = F.col(position).cast("bigint")
        sizes = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("__rows"), F.min(place).alias(START), F.max(place).alias("__end")
        )
        blocks = F.expr(f"(__rows + {block_rows - 1}) div {block_rows}")
        width = F.expr(f"(__end - {START}) div __blocks + 1").alias(WIDTH)
        large = settle(
            sizes.where(F.col("__rows") > block_rows).withColumn("__blocks", blocks).select(*keys, START, width)
        )
        marked = (
            df.join(large, list(keys), "left")
            .withColumn(BLOCK, F.expr(f"(`{position}` - {START}) div {WIDTH}"))
            .drop(START, WIDTH)
        )
        return cls(marked, keys, [position], blocked=True)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """Filter or extend the rows; grouping, order and blocks stay."""
        return Ordered(change(self._df), self.keys, self.order, self.blocked)

    @property
    def df(self) -> DataFrame:
        return self._df.drop(BLOCK)

    def scan(self, **scans: Scan) -> Ordered:
        """Add one column per running value."""
        parts = [*self.keys, BLOCK] if self.blocked else self.keys
        # a join that marked the blocks may have gathered whole groups
        rows = self._df.repartition(*parts) if self.blocked else self._df
        rows = rows.withColumns({name: self._inside(scan, parts) for name, scan in scans.items()})
        if self.blocked:
            carried = self._carried(scans, parts)
            rows = (
                rows.join(carried, parts, "left")
                .withColumns({name: self._joined(name, scan) for name, scan in scans.items()})
                .drop(*[f"__carry_{name}" for name in scans])
            )
        return Ordered(rows, self.keys, self.order, self.blocked)

    def _inside(self, scan: Scan, parts: list[str]) -> Column:
        """Value from the rows of the same group, or of the same block where there are blocks."""
        here = Window.partitionBy(*parts).orderBy(*self.order)
        before = here.rowsBetween(Window.unboundedPreceding, -1)
        match scan.kind:
            case "row_number":
                return F.row_number().over(here).cast("bigint")
            case "sum":
                return F.coalesce(F.sum(scan.value).over(before), F.lit(0))
            case "last_before":
                return F.last(scan.value, ignorenulls=True).over(before)
            case "last_so_far":
                return F.last(scan.value, ignorenulls=True).over(
                    here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
                )
            case "recent":
                return F.collect_list(scan.value).over(here.rowsBetween(-scan.size, -1))
        raise ValueError(scan.kind)

    def _carried(self, scans: dict[str, Scan], parts: list[str]) -> DataFrame:
        """One row per (group, block): what the earlier blocks of the group add up to."""
        cut = self._df.where(F.col(BLOCK).isNotNull())
        totals, tails = [F.count(F.lit(1)).alias("__rows")], None
        for name, scan in scans.items():
            match scan.kind:
                case "row_number":
                    totals.append(F.count(F.lit(1)).alias(name))
                case "sum":
                    totals.append(F.sum(scan.value).alias(name))
                case "last_before" | "last_so_far":
                    place = F.when(scan.value.isNotNull(), F.struct(*self.order))
                    totals.append(F.max_by(scan.value, place).alias(name))
                case "recent":
                    tail = self._tails(cut, name, scan, parts)
                    tails = tail if tails is None else tails.join(tail, parts, "full")
        blocks = cut.groupBy(*parts).agg(*totals)
        if tails is not None:
            blocks = blocks.join(tails, parts, "left")
        along = Window.partitionBy(*self.keys).orderBy(BLOCK)
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        folded = []
        for name, scan in scans.items():
            match scan.kind:
                case "row_number" | "sum":
                    carry = F.sum(name).over(before)
                case "last_before" | "last_so_far":
                    carry = F.last(name, ignorenulls=True).over(before)
                case "recent":
                    carry = F.flatten(F.collect_list(name).over(along.rowsBetween(-scan.size, -1)))
            folded.append(carry.alias(f"__carry_{name}"))
        return blocks.select(*parts, *folded)

    def _tails(self, cut: DataFrame, name: str, scan: Scan, parts: list[str]) -> DataFrame:
        """The last ``size`` rows of every block; Spark trims them before the shuffle."""
        latest = Window.partitionBy(*parts).orderBy(*[F.col(c).desc() for c in self.order])
        entry = F.struct(*self.order, scan.value.alias("__value"))
        return (
            cut.select(*parts, entry.alias("__entry"), *[c for c in self.order if c not in parts])
            .withColumn("__from_end", F.row_number().over(latest))
            .where(F.col("__from_end") <= scan.size)
            .groupBy(*parts)
            .agg(F.array_sort(F.collect_list("__entry"))["__value"].alias(name))
        )

    def _joined(self, name: str, scan: Scan) -> Column:
        inside, carry = F.col(name), F.col(f"__carry_{name}")
        match scan.kind:
            case "row_number" | "sum":
                return inside + F.coalesce(carry, F.lit(0))
            case "last_before" | "last_so_far":
                return F.coalesce(inside, carry)
        earlier = F.when(carry.isNull(), inside).otherwise(F.concat(carry, inside))
        return _last_items(earlier, scan.size)
