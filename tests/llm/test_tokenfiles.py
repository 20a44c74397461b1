"""Wavelet matrices, byte-level tokens and the shards of a corpus against plain versions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rallyframe.llm import bytebpe, queries, textbytes, tokenshards
from rallyframe.llm.wavelet import Bits, WaveletMatrix
from tests.llm.test_dedup import rank, rows_of
from tests.llm.test_queries import TINY, documents, tables

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "a", "b", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "'", "''", "1", "22", "#", "$%", "é",
    "×", "÷", "ß", "中", "е", "'s", "'re", "\r\n", "_", " ", "\x0b", "\x0c", "\x7f", "À",
    "ÿ", "ﬁ", "\U0001f600", "́", "½", "\x1c", "\x00", "<|endoftext|>", " ", " ", "​",
    "﻿", "　", "\x85", "᠎", " ",
]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 511, 512, 513, 5000, 40_001])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.zipf(1.4, n), 50_000).astype(np.uint16) if n != 5000 else rng.integers(0, 65_536, n).astype(np.uint16)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.of(x).to_bytes())
    assert (matrix.whole() == x).all()
    at = rng.integers(0, max(n, 1), 100)[: 100 if n else 0]
    assert (matrix.access(at) == x[at]).all()
    for number in [*set(x[:40].tolist()), 7, 65_535, 70_000]:
        assert matrix.count(number) == (x == number).sum()
        assert (matrix.occurrences(number) == np.flatnonzero(x == number)).all()
        low, high = sorted(rng.integers(0, n + 1, 2).tolist())
        assert matrix.count(number, low, high) == (x[low:high] == number).sum()


def test_one_number_only():
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.of(np.full(700, 5, np.uint16)).to_bytes())
    assert (matrix.whole() == 5).all() and matrix.count(5, 3, 650) == 647 and len(matrix.occurrences(4)) == 0


def test_frequent_numbers_take_few_bits():
    x = np.random.default_rng(1).choice(1000, 200_000, p=np.array([0.9] + [0.1 / 999] * 999)).astype(np.uint16)
    assert len(WaveletMatrix.of(x).to_bytes()) < 0.3 * x.nbytes
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(b"something else")


def test_bits():
    bits = np.random.default_rng(4).random(3000) < 0.2
    own = Bits.of(bits)
    for bit in (0, 1):
        want = np.flatnonzero(bits == bool(bit))
        assert (own.select(bit, np.arange(len(want))) == want).all()


def test_byte_tokens_are_the_library_s(corpus):
    rng = random.Random(8)
    odd = ["".join(rng.choice(ODD if k % 2 else ODD[:34]) for _ in range(rng.randint(0, 20))) for k in range(6000)]
    texts = [text for _, text in corpus] + odd + [None, "x'"] + ["s"]
    got = []
    for _, _, ids, bounds in bytebpe.encoded_bytes(pa.array(texts), PATH):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [ids_of(text) for text in texts]


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(bytebpe, "PART_BYTES", 200)
    rng = random.Random(1)
    plain = " ".join("".join(rng.choice("abcde'\n ") for _ in range(rng.randint(1, 9))) for _ in range(900))
    for text in (plain, plain.replace(" ", " "), "z" * 5000, plain + "<|endoftext|>" + plain):
        ((_, _, ids, _),) = bytebpe.encoded_bytes(pa.array([text]), PATH)
        assert ids.tolist() == ids_of(text)


def test_texts_over_a_slice():
    text = "some words, 'tis said, and more " * 60_000
    assert len(text) > textbytes.SLICE_BYTES
    ((_, _, ids, _),) = bytebpe.encoded_bytes(pa.array([text]), PATH)
    assert ids.tolist() == ids_of(text)


@pytest.fixture(scope="module")
def strange(corpus):
    rng = random.Random(6)
    rows = corpus + [(-7, "<|endoftext|> ! !"), (2**40, "  x"), (109, "! ! !")] + [(55, "same")] * 40
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_tokens, partitions", [(1 << 22, 3), (300, 5)])
def test_shards_round_trip(spark, strange, shard_tokens, partitions, monkeypatch, tmp_path):
    monkeypatch.setattr(tokenshards, "SHARD_TOKENS", shard_tokens)
    docs = spark.createDataFrame(strange, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS shard", "3 AS data")
    docs = docs.repartition(partitions)
    path = str(tmp_path / "ids")
    tokenshards.write_token_shards(docs, path, PATH, end_id=0)
    shards = tokenshards.shard_files(spark, path)
    got = sorted(tokenshards.read_documents(shards).collect(), key=lambda r: r["start"])
    assert [rank((r["doc_id"],)) for r in got] == sorted(rank((i,)) for i, _ in strange)
    stream, want = [], sorted(((i, [*ids_of(text), 0]) for i, text in strange), key=lambda r: (rank(r[:1]), r[1]))
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == len(stream) and r["n_tokens"] == len(ids)
        stream += ids
    mine = sorted(((r["doc_id"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in got), key=lambda r: (rank(r[:1]), r[1]))
    assert mine == want
    counts = dict(tokenshards.token_counts(shards, [0, 1, 50_256, 40_000]).collect())
    assert counts == {t: stream.count(t) for t in (0, 1, 50_256, 40_000)}
    found = tokenshards.token_occurrences(shards, [0, 50_256]).collect()
    places = [(t, i, k) for i, ids in want for k, t in enumerate(ids) if t in (0, 50_256)]
    assert sorted(map(tuple, found), key=rank) == sorted(places, key=rank)
    parts = sorted(tokenshards.token_slice(shards, 250, 900).collect())
    assert [x for r in parts for x in r["ids"]] == stream[250:1150]
    assert shards.filter(F.col("n_tokens") > shard_tokens).filter(
        F.col("n_documents") > 1).count() == 0 or shard_tokens == 300


def test_no_documents(spark, nothing, tmp_path):
    path = str(tmp_path / "ids")
    tokenshards.write_token_shards(nothing, path, PATH)
    shards = tokenshards.shard_files(spark, path)
    assert tokenshards.read_documents(shards).count() == 0
    assert dict(tokenshards.token_counts(shards, [3]).collect()) == {3: 0}


@tables
def test_token_query(spark):
    want, start = [], 0
    for i, text in sorted(documents(TINY)):
        ids = [*ids_of(text), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(queries.op13_token_shards(spark, TINY), "doc_id", "start", "n_tokens", "ids_crc32") == want
