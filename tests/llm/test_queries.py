"""Models on held-out rows, the registered queries on driver tables, and the pipeline stage by stage."""

import random
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from rallyframe.llm import quality, queries, toxicity
from tests.llm import brute
from tests.llm.test_dedup import rank, rows_of

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables not present")


def documents(folder):
    return duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts where a few words are toxic and symbols mean bad quality."""
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    bad = ["grumblex", "snarkoid", "flimbust"]
    rows = []
    for i in range(900):
        words = [rng.choice(pool) for _ in range(rng.randint(20, 120))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "s", "ed", "ing"])
        text = " ".join(words if good else [w + rng.choice(["###", "%%"]) for w in words])
        rows.append((i, text, rng.choice(["en", "de", None]), int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int").cache()


def test_toxicity_of_held_out_rows(labelled):
    held = F.col("doc_id") % 3 == 1
    model = toxicity.fit_toxicity(labelled, labelled, where=~held)
    scored = toxicity.toxicity(labelled, model, carry=["toxic"]).join(labelled.select("doc_id", F.col("toxic").alias("y")), "doc_id")
    rows = scored.filter(held).collect()
    assert sum((r["score"] >= 0.7) == bool(r["y"]) for r in rows) > 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_is_no_input_of_a_score(labelled):
    model = toxicity.fit_toxicity(labelled, labelled, sample_rows=300)
    other = labelled.withColumn("lang", F.lit("xx"))
    assert rows_of(toxicity.toxicity(labelled, model), "doc_id", "score") == rows_of(toxicity.toxicity(other, model), "doc_id", "score")


def test_scores_of_odd_inputs(spark, docs, nothing, corpus):
    labels = spark.createDataFrame([(0, 1, None), (1, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.toxicity(docs, model, carry=["kept", "score"]).filter("score BETWEEN 0 AND 1").count() == len(corpus)
    assert toxicity.toxicity(nothing.drop("lang"), model).count() == 0
    assert quality.quality_rules(nothing, quality.fit_quality(nothing, labels)).count() == 0


def test_quality_of_held_out_rows(labelled):
    part = labelled.filter("doc_id % 2 = 0")
    model = quality.fit_quality(part, part)
    rows = quality.quality_rules(labelled, model).join(labelled.select("doc_id", F.col("quality").alias("y")), "doc_id")
    rows = rows.filter("doc_id % 2 = 1").collect()
    assert sum((r["quality"] >= 0.5) == bool(r["y"]) for r in rows) > 0.95 * len(rows)


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = duck.execute(queries.SQL[name])
    columns = sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    expected = sorted((tuple(plain(r[k]) for k in place) for r in want.fetchall()), key=rank)
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == columns
    assert sorted((tuple(plain(x) for x in r) for r in got.select(*columns).collect()), key=rank) == expected


@tables
def test_suffix_query(spark):
    want = sorted((i, n, r, s, brute.sha(kept)) for i, n, r, s, kept in brute.suffixes(documents(TINY)))
    got = queries.op7_suffixes(spark, TINY)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@tables
def test_near_duplicate_query(spark):
    want = sorted((*r, r[0] == r[2]) for r in brute.near_duplicates(documents(TINY)))
    got = queries.op9_near_duplicates(spark, TINY)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == want


@tables
def test_shard_query(spark):
    rows = sorted(queries.op10_shards(spark, TINY).collect(), key=lambda r: (r["shard"], r["slot"]))
    want = [(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in sorted(documents(TINY))]
    assert [(r["doc_id"], r["size"], r["text_crc32"]) for r in rows] == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


@tables
def test_quality_and_toxicity_queries(spark):
    want = sorted((i, *brute.quality_counts(t)) for i, t in documents(TINY))
    got = queries.op3_quality(spark, TINY)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    toxic = queries.op8_toxicity(spark, TINY).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in toxic)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in toxic)


@tables
def test_cross_entropy_and_packing_queries(spark):
    assert queries.op4_cross_entropy(spark, TINY).filter("difference IS NOT NULL").count() == 200
    rows = queries.op5_packing(spark, TINY).collect()
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 4096)


def test_pipeline_stages(spark, corpus, docs, items_folder):
    """Every stage against a plain version of it, on what the stage before has kept."""
    now = docs.withColumn("n_chars", F.length("text"))
    names = now.columns
    for (_, stage), check in zip(corpus_pipeline.STAGES[:4], CHECKS):
        out = stage(spark, now, items_folder).cache()
        assert out.columns == names
        before = [tuple(r) for r in now.select("doc_id", "text").collect()]
        after = sorted((tuple(r) for r in out.select("doc_id", "text").collect()), key=rank)
        check(before, after)
        assert out.filter("n_chars != length(text)").count() == 0
        now = out
    packed = corpus_pipeline.STAGES[4][1](spark, now, items_folder)
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def after_quality(before, after):
    kept = [(i, t) for i, t in before if brute.quality_counts(t)[0] >= 10 and 5 * brute.quality_counts(t)[4] <= brute.quality_counts(t)[0]]
    assert after == sorted(kept, key=rank)  # labels are all good: the model keeps what the rules keep


def after_near(before, after):
    least = {i: c for i, _, c in brute.near_duplicates(before)}
    assert after == sorted(((i, t) for i, t in before if i is None or least[i] == i), key=rank)


def after_substrings(before, after):
    texts = {(i, n, r): k for i, n, r, k in brute.substrings(before)}
    assert len(after) <= len(before)
    want = [(i, k) for (i, n, r), k in texts.items() if r and r < n]
    assert [x for x in want if x not in after] == []
    assert all(x in before or x in want for x in after)


def after_benchmark(before, after):
    hits = {i: h for i, _, h, _ in brute.benchmark(before, ITEMS)}
    assert any(hits.values())
    assert all(x in before for x in after if not hits[x[0]])
    assert all(len(dict(after)[i].split()) < len(dict(before)[i].split()) for i in dict(after) if hits[i])


CHECKS = [after_quality, after_near, after_substrings, after_benchmark]
ITEMS = []


@pytest.fixture(scope="module")
def items_folder(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    long = dict(corpus)[107].split(" ")
    ITEMS[:] = [(7, " ".join(long[100:140])), (8, " ".join(long[3000:3012]))]
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i, _ in corpus if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_every_query_is_registered():
    names = entry_point.queries()
    assert {n for n in names if n.startswith("op")} == set(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in names and set(queries.SQL) <= set(entry_point.oracle_sql())
