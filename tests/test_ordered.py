"""Running values must not depend on how large groups are cut, nor on the order rows arrive in."""

import random

import pytest
from pyspark.sql import functions as F

from rallyframe.operators import ordered as O


def rows(seed=1, n=600):
    rng = random.Random(seed)
    out = []
    for position in range(n):
        # key "h" holds about a third of the rows, the others are small
        key = "h" if rng.random() < 0.35 else f"k{rng.randrange(40)}"
        out.append((key, position, rng.choice([None, 1, 2, 3, 4]), rng.choice("abc")))
    rng.shuffle(out)
    return out


def brute(data):
    """position -> expected values, by walking each group in order."""
    groups = {}
    for row in data:
        groups.setdefault(row[0], []).append(row)
    expected = {}
    for members in groups.values():
        members.sort(key=lambda row: row[1])
        for place, (_, position, _, _) in enumerate(members):
            before = members[:place]
            values = [row[2] for row in before if row[2] is not None]
            so_far = [row[2] for row in members[: place + 1] if row[2] is not None]
            expected[position] = (
                place + 1,
                sum(1 for row in before if row[3] == "a"),
                sum(values),
                values[-1] if values else None,
                so_far[-1] if so_far else None,
                (before[-1][2], before[-1][3]) if before else None,
                [row[3] for row in before[-4:]],
            )
    return expected


def scanned(ordered):
    df = ordered.scan(
        number=O.row_number(),
        n_a=O.count_before(F.col("code") == "a"),
        total=O.sum_before(F.col("value")),
        last=O.last_before(F.col("value")),
        latest=O.last_so_far(F.col("value")),
        before=O.previous("value", "code"),
        window=O.recent(4, "code"),
    ).df
    return {
        row.position: (
            row.number,
            row.n_a,
            row.total,
            row["last"],
            row.latest,
            tuple(row.before) if row.before else None,
            [item.code for item in row.window],
        )
        for row in df.collect()
    }


SCHEMA = "key string, position bigint, value int, code string"


@pytest.mark.parametrize("block_rows", [3, 10, 64, 1 << 20])
def test_scans_match_brute_force_for_any_block_size(spark, block_rows):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    ordered = O.Ordered.by_position(df, ["key"], "position", block_rows=block_rows)
    assert scanned(ordered) == brute(data)


def test_plain_groups_match_brute_force(spark):
    data = rows(seed=2)
    df = spark.createDataFrame(data, SCHEMA)
    assert scanned(O.Ordered.bounded(df, ["key"], ["position"])) == brute(data)


def test_given_blocks_match_brute_force(spark):
    data = rows(seed=3)
    df = spark.createDataFrame(data, SCHEMA)
    block = F.when(F.col("key") == "h", F.floor(F.col("position") / 17))
    assert scanned(O.Ordered.by_block(df, ["key"], ["position"], block)) == brute(data)


def test_second_scan_sees_filtered_rows(spark):
    data = rows(seed=4)
    df = spark.createDataFrame(data, SCHEMA)
    ordered = (
        O.Ordered.by_position(df, ["key"], "position", block_rows=8)
        .scan(number=O.row_number())
        .map(lambda frame: frame.where(F.col("code") != "b"))
        .scan(before=O.previous("number"))
    )
    got = {row.position: row.before.number if row.before else None for row in ordered.df.collect()}
    numbers = {position: values[0] for position, values in brute(data).items()}
    kept = [row for row in data if row[3] != "b"]
    want = {}
    for key in {row[0] for row in kept}:
        last = None
        for _, position, _, _ in sorted((row for row in kept if row[0] == key), key=lambda row: row[1]):
            want[position] = last
            last = numbers[position]
    assert got == want


def test_large_group_is_spread_and_small_groups_are_not(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    ordered = O.Ordered.by_position(df, ["key"], "position", block_rows=32)
    blocks = ordered._df.groupBy("key").agg(F.countDistinct(O.BLOCK).alias("n")).collect()
    assert {row.key for row in blocks if row.n > 0} == {"h"}
    n = df.where("key = 'h'").count()
    assert next(row.n for row in blocks if row.key == "h") == -(-n // 32)
    largest = ordered._df.where("key = 'h'").groupBy(O.BLOCK).count().agg(F.max("count")).first()[0]
    assert largest <= 64


def test_sparse_positions_give_no_more_blocks_than_rows_need(spark):
    data = [(key, position * 1_000_000, value, code) for key, position, value, code in rows(seed=6)]
    df = spark.createDataFrame(data, SCHEMA)
    ordered = O.Ordered.by_position(df, ["key"], "position", block_rows=32)
    n = df.where("key = 'h'").count()
    assert ordered._df.where("key = 'h'").select(O.BLOCK).distinct().count() <= n // 32 + 1
    assert scanned(ordered) == brute(data)


def test_no_large_group_leaves_a_plain_window(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    result = O.Ordered.by_position(df, ["key"], "position").scan(number=O.row_number()).df
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Window [") == 1
    assert "SortMergeJoin" not in final
