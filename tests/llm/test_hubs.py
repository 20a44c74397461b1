"""Near-duplicate work stays in proportion to a group, and hot hubs are dealt over blocks."""

import random

from rallyframe.llm import components as components_module
from rallyframe.llm import neardup
from tests.llm import brute


def test_texts_that_are_alike_but_not_enough(spark, monkeypatch):
    """A page with many variants: every two share most shingles, none enough; few pairs may reach the full texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(4000)]
    page = [rng.choice(words) for _ in range(800)]
    rows = []
    for k in range(70):
        own = list(page)
        for at in rng.sample(range(800), 17):
            own[at] = f"{rng.choice(words)}{k}"
        rows.append((k, " ".join(own)))
    asked = []
    confirmed = neardup._confirmed

    def watched(pairs, texts, size, percent):
        pairs = neardup.settle(pairs)
        asked.append(pairs.count())
        return confirmed(pairs, texts, size, percent)

    monkeypatch.setattr(neardup, "_confirmed", watched)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4)
    want = sorted((*r, r[0] == r[2]) for r in brute.near_duplicates(rows))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == want
    assert max(asked) < 5 * len(rows), asked


def test_hubs_in_blocks_and_shares(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "HUB_BLOCK", 2)
    monkeypatch.setattr(components_module, "SHARE_ROWS", 2)
    got = neardup.near_duplicates(docs, size=4)
    want = sorted((*r, r[0] == r[2]) for r in brute.near_duplicates(corpus) if r[0] is not None)
    rows = got.filter("doc_id IS NOT NULL").select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, rows)) == want
    links = spark.createDataFrame([(0, k) for k in range(1, 30)] + [(29, 40)], "a long, b long")
    assert dict(components_module.components(links).collect()) == {k: 0 for k in [*range(30), 40]}
