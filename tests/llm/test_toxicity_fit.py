"""The toxicity model learns from every labelled row, in parts that are averaged."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe.llm import samples, toxicity


def test_rows_beyond_any_sample_and_long_texts_are_learned(spark):
    """The rows with the largest hashes of their ids, and texts over 32 KB, alone hold the words asked for."""
    ids = spark.range(9000).select(F.col("id").alias("doc_id"), F.rank().over(Window.orderBy(F.xxhash64("id"))).alias("place"))
    last, long = F.col("place") > 8600, F.col("place") < 250
    word = F.when(last, F.lit(" zorkoid")).when(long, F.lit(" quibblat")).otherwise(F.lit(""))
    more = F.when(long, F.repeat(F.lit("plain words here "), 2000)).otherwise(F.lit(""))
    toxic = (last | long).cast("int").alias("toxic")
    rows = ids.select("doc_id", F.concat(F.lit("some plain words"), word, F.lit(" "), more).alias("text"), toxic).cache()
    model = toxicity.fit_toxicity(rows, rows)
    asked = spark.createDataFrame([(1, "some zorkoid words"), (2, "some quibblat words"), (3, "some plain words")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(asked, model).collect()}
    assert got[1] > 0.5 > got[3] and got[2] > 0.5


def test_many_parts_learn_as_one(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for k in range(2400):
        words = [f"w{rng.randrange(800)}" for _ in range(rng.randint(10, 40))]
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grumblex", "snarkoid"])
        rows.append((k, " ".join(words), rng.choice(["en", None]), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").cache()
    monkeypatch.setattr(toxicity, "PART_ROWS", 250)
    held = F.col("doc_id") % 4 == 1
    model = toxicity.fit_toxicity(frame, frame, where=~held)
    scored = toxicity.toxicity(frame, model, carry=["toxic"]).join(frame.select("doc_id", F.col("toxic").alias("y")), "doc_id")
    found = scored.where(held).collect()
    assert sum((r["score"] >= 0.7) == bool(r["y"]) for r in found) > 0.95 * len(found)


@pytest.mark.parametrize("ranges", [2, 256])
def test_sums_over_rows_give_the_plain_calibration_and_thresholds(spark, monkeypatch, ranges):
    monkeypatch.setattr(samples, "SCORE_RANGES", ranges)
    rng = random.Random(5)
    rows = []
    for name in ("", "de", "en"):
        for _ in range(400):
            raw = round(rng.gauss(0, 2), 1)
            rows.append((name, raw, int(name != "de" and rng.random() < 1 / (1 + np.exp(-2 * raw)))))
    frame = spark.createDataFrame(rows, "name string, raw double, label int").cache()
    plain = samples.platt(np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float64))
    assert samples.platt_of(frame) == pytest.approx(plain, rel=1e-9)
    found = {r["name"]: r for r in samples.precise_thresholds(frame.withColumnRenamed("raw", "score"), 0.9).collect()}
    for name in ("", "de", "en"):
        own = [(raw, label) for n, raw, label in rows if n == name]
        good = [s for s in {r[0] for r in own} if np.mean([y for x, y in own if x >= s]) >= 0.9]
        assert found[name]["threshold"] == (min(good) if good and name != "de" else 0.5)
        assert (found[name]["n"], found[name]["hits"]) == (400, sum(y for _, y in own))
