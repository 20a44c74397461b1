import random

import pytest


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnoprstuvwäéñ") for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(id, text): prose, exact and near copies, shared passages, lines, junk, empty, null and very long texts."""
    rng = random.Random(5)
    pool = vocabulary(rng, 900)
    prose = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    passage, rows = prose(70), []
    base = prose(150).split(" ")
    for i in range(90):
        text = prose(rng.randint(1, 160))
        if i % 5 == 0:
            text = f"{text} {passage}\n{prose(12)}"
        if i % 7 == 0:
            near = list(base)
            for _ in range(rng.randint(1, 5)):
                near[rng.randrange(len(near))] = rng.choice(pool)
            text = " ".join(near)
        if i % 11 == 0 and i:
            text = rows[i // 2][1]
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "ab " * 400), (105, "x" * 900)]
    rows += [(106, "Line of text here\nLine of text here\n\nline OF text here"), (107, prose(4000) + " " + passage)]
    rows += [(108, passage + " " + passage), (109, "#$% && <a|b> *é*"), (None, passage), (103, "one"), (110, "abc def " * 60)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with results."""
    frame = spark.createDataFrame(corpus, "doc_id long, text string")
    extra = "'k' AS kept", "1 AS score", "'z' AS chunk", "2 AS n_words", "'de' AS lang", "3 AS `odd name.x`", "7 AS node"
    return frame.selectExpr("*", *extra).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
