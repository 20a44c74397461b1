"""Substring, suffix and near-duplicate removal against plain versions, however the corpus is cut."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from rallyframe.llm import chunks, neardup, substrings, suffixes
from rallyframe.llm.components import components
from tests.llm import brute


def rank(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def rows_of(frame, *names):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in frame.select(*names).collect()), key=rank)


@pytest.mark.parametrize("chunk_bytes, bucket_keys", [(4 << 20, 1 << 20), (3000, 500)])
def test_substrings(docs, corpus, chunk_bytes, bucket_keys, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(substrings, "BUCKET_KEYS", bucket_keys)
    got = substrings.substring_dedup(docs, carry=["kept", "odd name.x"])
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text", "kept", "odd name.x"]
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.substrings(corpus), key=rank)


def test_carried_names_of_results_are_left_out(docs):
    assert "n_words" in docs.columns
    got = substrings.substring_dedup(docs, carry=["n_words", "lang"])
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text", "lang"]


@pytest.mark.parametrize("chunk_bytes, bucket_keys, hot", [(4 << 20, 1 << 15, 1 << 14), (3000, 200, 1 << 14), (3000, 200, 3)])
def test_suffixes(docs, corpus, chunk_bytes, bucket_keys, hot, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(suffixes, "BUCKET_KEYS", bucket_keys)
    monkeypatch.setattr(suffixes, "SKETCH_KEYS", bucket_keys)
    monkeypatch.setattr(suffixes, "HOT_ANCHOR", hot)
    monkeypatch.setattr(suffixes, "ORDER_BYTES", 4000)
    got = suffixes.suffix_dedup(docs)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.suffixes(corpus), key=rank)
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_near_duplicates(docs, corpus):
    got = neardup.near_duplicates(docs, size=4)
    want = sorted((*r, r[0] == r[2]) for r in brute.near_duplicates(corpus) if r[0] is not None)
    mine = rows_of(got, "doc_id", "n_shingles", "component_id", "kept")
    assert [r for r in mine if r[0] is not None] == want
    assert [r[2:] for r in mine if r[0] is None] == [(None, True)]


def test_members_linked_to_no_hub_are_linked_to_each_other(spark):
    """A chain: each text shares enough with the next one only."""
    w = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(w[12 * k : 12 * k + 160])) for k in range(12)] + [(50, " ".join(w[:160]) + " w160")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4)
    want = sorted((*r, r[0] == r[2]) for r in brute.near_duplicates(rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {k: 1 for k in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_empty_tables(nothing):
    assert substrings.substring_dedup(nothing, carry=["lang"]).count() == 0
    assert suffixes.suffix_dedup(nothing).count() == 0
    assert neardup.near_duplicates(nothing).count() == 0


def test_counts_of_a_single_chunk_reach_every_level():
    """A key that one chunk alone has, far more often than a byte can say."""
    sketch = chunks.Sketch(1000, 3, levels=(2, 16_384))
    keys = np.arange(5, dtype=np.uint64) * np.uint64(123_456_789_123_456_789)
    said = chunks.asked(*sketch.ask(0, keys, np.array([40_000, 1, 2, 16_384, 16_383])))
    numbers = sorted(set(said.column("bucket").to_pylist()))
    told = pa.concat_tables([sketch.merge(said.filter(pc.equal(said.column("bucket"), b))) for b in numbers])
    twice, hot = sketch.reached(told, keys)
    assert twice.tolist() == [True, False, True, True, True]
    assert hot.tolist() == [True, False, False, True, False]
