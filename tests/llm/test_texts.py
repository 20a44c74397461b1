"""Tokens, packing, shards, benchmark overlap, quality counts, licences and losses against plain versions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rallyframe.llm import chunks, crossentropy, decontaminate, licences, packing, quality, sharding
from rallyframe.llm.fmindex import FMIndex
from rallyframe.llm.wordbpe import encoded
from tests.llm import brute
from tests.llm.test_dedup import rank, rows_of

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "don't stop'S  I'LL é́ á ﬁ Σας İstanbul x y a\u0085b 12½³ \x1c\x00 q",
    "ÀÉÎÕÜ×÷ß ÿ Œuvre 😀😀 中文字 test's",
    "a" * 100 + " " + "%" * 300 + "!!??" + "é" * 60,
    "<|endoftext|> <|startoftext|>hi", "a <|endoftext|> b", "a<|endoftext|>B <|ENDOFTEXT|> <|endoftext|", "|><|startoftext",
    "Ǆ ǅ ŉ ſ ß ẞ ſ's 1234567890 a1b2",
    "",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_tokens_are_the_library_s(corpus, library):
    texts = [text for _, text in corpus] + ODD
    got = []
    for _, _, ids, bounds in encoded(pa.array(texts), PATH, limit=2000):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [library(text) for text in texts]


@pytest.mark.parametrize("leaf", [16_384, 20])
def test_packing(docs, corpus, library, leaf, monkeypatch):
    monkeypatch.setattr(packing, "LEAF_ITEMS", leaf)
    capacity = 256
    pieces = packing.token_pieces(docs, PATH, end_id=1, capacity=capacity)
    placed = packing.packed(pieces.withColumn("sequence_id", F.lit("old")), capacity).collect()
    want = Counter()
    for i, text in corpus:
        ids = np.array([*library(text), 1], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            want[i, n, at, len(ids[at : at + capacity]), ids[at : at + capacity].tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in placed) == want
    bins = defaultdict(list)
    for r in placed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    whole = len(packing.best_fit(np.array([r["length"] for r in placed]), capacity)[2])
    assert len(bins) <= (whole if leaf > len(placed) else 1.05 * whole + 1)


def test_bins_that_fit_nowhere_end_the_tree(spark, monkeypatch):
    """Pieces over half a sequence: no two fit, however often they meet."""
    monkeypatch.setattr(packing, "LEAF_ITEMS", 10)
    rows = spark.range(100).selectExpr("id AS doc_id", "CAST(150 AS LONG) AS length")
    got = packing.packed(rows, 256).collect()
    assert len({r["sequence_id"] for r in got}) == 100 and {r["offset"] for r in got} == {0}


def test_sequences_hold_their_pieces(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (2, "g h"), (3, "i j k")], "doc_id long, text string")
    pieces = packing.token_pieces(frame, PATH, capacity=5)
    whole = packing.sequences(pieces, packing.packed(pieces, 5)).collect()
    assert sorted(x for r in whole for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()) == sorted(
        x for r in pieces.collect() for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    )
    assert all(len(r["ids"]) == 4 * r["length"] <= 20 for r in whole)


def test_shards(docs, corpus):
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"), "kept")
    got = sharding.byte_shards(rows, F.col("bytes") + 8, ["doc_id", "bytes"], 7).collect()
    assert len(got) == len(corpus)
    assert sorted(got, key=lambda r: (r["shard"], r["slot"])) == sorted(got, key=lambda r: rank((r["doc_id"], r["bytes"])))
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    large = max(r["size"] for r in got)
    assert all(abs(x - sum(sizes.values()) / 7) <= large for x in sizes.values())


def test_one_order_value_may_hold_all_rows(spark):
    rows = spark.range(500).select(F.lit(3).alias("doc_id"), F.lit(10).alias("bytes"))
    got = sharding.byte_shards(rows, F.col("bytes"), ["doc_id"], 5).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [100] * 5
    assert sharding.byte_shards(rows.limit(0), F.col("bytes"), ["doc_id"], 5).count() == 0


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 700)
    index = FMIndex(text, 5)
    for length in (1, 2, 4, 7):
        patterns = rng.integers(1, 5, (50, length))
        low, high = index.search(patterns)
        for pattern, a, b in zip(patterns, low, high):
            want = [k for k in range(len(text) - length + 1) if (text[k : k + length] == pattern).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.fixture(scope="module")
def items(corpus):
    texts = {i: text for i, text in corpus}
    long = texts[107].split(" ")
    return [
        (7, " ".join(long[100:140]).upper()), (12, "one"), (None, " ".join(long[120:131])), (3, ""), (4, None),
        (5, " ".join(texts[0].split(" ")[-30:])), (5, "abc DEF abc"), (6, "never seen here at all"),
    ]


@pytest.mark.parametrize("pass_bytes, shard_bytes", [(8 << 20, 2 << 20), (150, 3000)])
def test_benchmark(spark, docs, corpus, items, pass_bytes, shard_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard_bytes)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.benchmark_overlap(docs, asked, clean=True, carry=["lang"])
    want = sorted(brute.benchmark(corpus, items), key=lambda r: rank(r[:3]))
    mine = got.select("doc_id", "n_words", "n_hit", "items", "cleaned", "spans").collect()
    assert sorted([tuple(r[:4]) for r in mine], key=lambda r: rank(r[:3])) == want
    by_id = dict(corpus)
    for r in mine:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        if not r["n_hit"]:
            assert r["cleaned"] in [t for i, t in corpus if i == r["doc_id"]]
        elif r["doc_id"] is not None:
            assert len(brute.alnum(r["cleaned"])) >= r["n_words"] - r["n_hit"]
            assert len(r["cleaned"]) < len(by_id[r["doc_id"]])


def test_benchmark_of_nothing(spark, docs, nothing, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.benchmark_overlap(docs, none).collect()} == {0}
    assert decontaminate.benchmark_overlap(nothing, none, clean=True).count() == 0


def test_quality_counts(spark, docs, corpus):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = quality.quality_rules(docs, model, carry=["lang"])
    want = sorted(((i, *brute.quality_counts(text)) for i, text in corpus), key=rank)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_licences(docs, corpus, spark, nothing):
    texts = {"A": "Released under the MIT License.", "B": "licensed under cc by nc 4.0 a b c", "C": "the MIT License released"}
    rows = corpus + [(200, "x\nReleased under the MIT license\nby nobody"), (201, "Licensed under CC-BY NC 4.0: A b C!\n\nfoo")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = licences.licence_scan(frame, texts, threshold=0.6)
    want = []
    for i, text in rows:
        found = brute.licences(text, texts, 0.6)
        best = min(found, key=lambda x: (-x[1], x[0]), default=(None, None))
        want.append((i, len(brute.segments(text)), sorted(found), *best))
    mine = [
        (r["doc_id"], r["n_segments"], sorted((m["licence"], m["dice"]) for m in r["licences"]), r["best_licence"], r["best_dice"])
        for r in got.collect()
    ]
    assert sorted(mine, key=lambda r: rank(r[:2])) == sorted(want, key=lambda r: rank(r[:2]))
    assert {r[3] for r in mine} >= {"A", "B"}
    assert licences.licence_scan(nothing).count() == 0


def losses(text, sequence, chosen, weight, size, strength=crossentropy.STRENGTH, extra=crossentropy.EXTRA):
    single, pair = Counter(), Counter()
    for other, s in chosen:
        if other != text:
            single.update(s[1:])
            pair.update(zip(s, s[1:]))
    total, out = weight * sum(single.values()), 0.0
    for a, b in zip(sequence, sequence[1:]):
        one = (weight * single[b] + extra) / (total + extra * (size + 1))
        out -= math.log((weight * pair[a, b] + strength * one) / (weight * single[a] + strength))
    return out / (len(sequence) - 1)


@pytest.mark.parametrize("chunk_bytes, bucket_keys", [(4 << 20, 1 << 20), (3000, 400), (3000, 20)])
def test_cross_entropy(spark, docs, corpus, library, chunk_bytes, bucket_keys, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(crossentropy, "BUCKET_KEYS", bucket_keys)
    target = [3, 5, 11, 22, 103, 103, 108, None, 777]
    given = spark.createDataFrame([(x,) for x in target], "doc_id long")
    got = crossentropy.cross_entropy_difference(docs, given, PATH, carry=["lang", "odd name.x", "n_tokens"])
    assert got.columns == [*crossentropy.RESULTS, "lang", "odd name.x"]
    size = Tokenizer.from_file(PATH).get_vocab_size()
    every = [(i, text or "", [size, *library(text), size]) for i, text in corpus]
    sets = [
        [(text, s) for i, text, s in every if i is not None and i in target],
        [(text, s) for i, text, s in every if i is None or i not in target],
    ]
    large = [sum(len(s) - 1 for _, s in x) for x in sets]
    weight = [min(large) / x for x in large]
    want = sorted(
        ((i, len(s) - 2, *(losses(text, s, x, w, size) for x, w in zip(sets, weight))) for i, text, s in every),
        key=rank,
    )
    mine = rows_of(got, "doc_id", "n_tokens", "target_loss", "background_loss")
    assert [r[:2] for r in mine] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in mine], [r[2:] for r in want], rtol=1e-9)


def test_cross_entropy_does_not_tell_who_was_in_the_target(spark):
    """Two halves of equally good documents, one of them the target: both are as close to it."""
    folder = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1 AND toxic = 0")
    half = good.select("doc_id", (F.xxhash64("doc_id", F.lit("half")) % 2 == 0).alias("mine"))
    got = crossentropy.cross_entropy_difference(texts, half.filter("mine"), PATH).join(half, "doc_id")
    quarters = F.percentile("difference", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    mine, other = (r[1] for r in got.groupBy("mine").agg(quarters).orderBy(F.desc("mine")).collect())
    assert abs(mine[1] - other[1]) < 0.1
    assert mine[0] < other[1] < mine[2] and other[0] < mine[1] < other[2]


def test_cross_entropy_of_nothing(spark, nothing, docs):
    none = spark.createDataFrame([], "doc_id long")
    assert crossentropy.cross_entropy_difference(nothing, none, PATH).count() == 0
    every = docs.select("doc_id").filter("doc_id IS NOT NULL")
    assert crossentropy.cross_entropy_difference(docs, none, PATH).filter("difference = 0").count() == docs.count()
    known = docs.filter("doc_id IS NOT NULL")
    assert crossentropy.cross_entropy_difference(known, every, PATH).filter("difference <> 0").count() == 0


def test_checksums_are_of_little_endian_ids(spark, library):
    frame = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    row = packing.token_pieces(frame, PATH).select(F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(np.array([*library("some words"), 1], "<u4").tobytes())
