"""Spelling variants against a plain version: deletion neighbourhoods of all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rallyframe.llm import queries, spelling
from tests.llm.test_dedup import rows_of
from tests.llm.test_queries import TINY, documents, tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, length=6, least=5, one_in=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def plain_variants(counts, times=5):
    gaps = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            gaps[w[:k] + w[k + 1 :], k].add(w)
    near = {w: set() for w in counts}
    for w in counts:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            near[w] |= gaps[less, k] - {w}
            if less in counts:
                near[w].add(less)
                near[less].add(w)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= times * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out)


def variants(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def slips():
    """Words in chains, ties, anagrams, very long runs and letters beyond ASCII, with odd ids and texts."""
    rng = random.Random(2)
    base = ["".join(rng.choice("abeinorstäéß") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    words = Counter({w: rng.choice([7, 40, 300]) for w in base})
    for w in base:
        for _ in range(4):
            k = rng.randrange(len(w))
            words[rng.choice([w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "o" + w[k + 1 :]])] += rng.choice([1, 5, 6, 50])
    words |= Counter({"abcdefg": 8, "abcdefgh": 60, "abcdefghi": 400, "abcdefghij": 2400, "zbcdefg": 60, "AbcdefxÀ": 9})
    words |= Counter({"x" * 90: 30, "x" * 91: 6, "x" * 300: 5, "x" * 299 + "y": 5, "y" + "x" * 299: 25})
    for _ in range(80):
        words["".join(rng.sample("aabbeeoo", 8))] += 6  # many words with the same counts
    flat = [w for w, n in words.items() for _ in range(n)]
    rng.shuffle(flat)
    rows = [(k, " ".join(flat[a : a + 70])) for k, a in enumerate(range(0, len(flat), 70))]
    return rows + [(None, " ".join(flat[:300])), (3, None), (3, ""), (5, "12 中文 ×÷×÷×÷" * 5), (3, flat[0])]


@pytest.mark.parametrize("part_words, few, pairs, one_in", [(1024, 8, 1 << 16, 199), (5, 1, 3, 7), (30, 2, 50, 0)])
def test_variants(spark, slips, part_words, few, pairs, one_in, monkeypatch):
    monkeypatch.setattr(spelling, "PART_WORDS", part_words)
    monkeypatch.setattr(spelling, "FEW", few)
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    docs = spark.createDataFrame(slips, "doc_id long, text string").selectExpr("*", "1 AS n", "'q' AS word").repartition(3)
    words = spelling.counted_words(docs, one_in=one_in)
    want = plain_words(slips, one_in=one_in)
    assert dict(words.collect()) == want
    got = variants(spelling.spelling_variants(words))
    assert got == plain_variants(want)
    assert any(r[1] for r in got) and any(r[1] not in (None, r[2]) for r in got)


def test_words_that_share_all_counts_are_cut_into_blocks():
    words = [bytes(x) for x in {tuple(random.Random(k).sample(list(b"abcdefgh"), 8)) for k in range(300)}]
    vectors = spelling.group_counts(words)
    parts = spelling.Parts({vectors[0].tobytes(): len(words)}, 50)
    assert parts.count == -(-len(words) // 50)
    who, part, home = parts.reached(vectors, np.arange(len(words)))
    assert Counter(part[home].tolist()) == Counter(k % parts.count for k in range(len(words)))
    assert all(set(part[who == k].tolist()) == set(range(k % parts.count, parts.count)) for k in range(len(words)))


def test_checksums_of_runs():
    raw = np.frombuffer(b"abc" + b"z" * 200 + b"hello", np.uint8)
    starts, ends = np.array([0, 3, 203]), np.array([3, 203, 208])
    prefix = np.array([zlib.crc32(b"17:")] * 3, np.uint32)
    want = [zlib.crc32(b"17:" + raw[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert spelling._checksums(raw, starts, ends, prefix).tolist() == want


def test_no_words(spark, nothing):
    words = spelling.counted_words(nothing)
    assert words.count() == 0
    assert spelling.spelling_variants(words).collect() == []


@tables
def test_spelling_query(spark):
    got = queries.op11_spelling(spark, TINY)
    assert rows_of(got, "word")
    assert variants(got) == plain_variants(plain_words(documents(TINY)))
