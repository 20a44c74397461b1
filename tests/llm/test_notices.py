"""The licence query against notices that are written out here, whatever templates the package has."""

import random

import numpy as np
import pytest

from rallyframe.llm import licences, queries
from tests.llm import brute

BODY = "A story about nothing in particular.\nIt goes on for a second line.\n\n"
#: Text and the licence that it names.
NOTICES = [
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0 notice"),
    ("All rights reserved.", "All rights reserved notice"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0 notice"),
    ("Released under the MIT License.", "MIT notice"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0 notice"),
    ("All rights reserved. No part of this work may be reproduced without written permission.", "Proprietary notice"),
]


@pytest.fixture(scope="module")
def best(spark, tmp_path_factory):
    """The query's best licence by text."""

    def found(texts):
        folder = str(tmp_path_factory.mktemp("notices"))
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        frame.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        rows = {r["doc_id"]: r for r in queries.op2_licences(spark, folder).collect()}
        return [(rows[i]["best_licence"], rows[i]["best_dice"]) for i in range(len(texts))]

    return found


def test_a_notice_on_the_last_line(best):
    got = best([BODY + text for text, _ in NOTICES] + [BODY])
    assert got == [(licence, 1.0) for _, licence in NOTICES] + [(None, None)]


GPL = (
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public "
    "License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any "
    "later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without "
    "even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)


def test_notices_inside_longer_lines_and_comments(best):
    star = "/*\n * Copyright (C) 2020 A Person\n *\n * " + GPL.replace("\n", "\n * ") + "\n */\nint x;"
    hashes = "#!/bin/sh\n# A tool.\n#\n# " + GPL.replace("\n", "\n# ") + "\n#\n"
    got = best(
        [
            star,
            hashes,
            "Copyright 2020 A Person and others, all rights reserved, and so on for the rest of a long line of words.",
            "The files of this folder and of the others are released under the MIT License. See the list of authors.",
            "all the rights are reserved to whom the rights belong",
            "Something else is released.\nUnder the table the MIT people have a license.",
        ]
    )
    wanted = ["GPL header", "GPL header", "All rights reserved notice", "MIT notice", None, None]
    assert [licence for licence, _ in got] == wanted
    assert all(dice == 1.0 for _, dice in got[:4])


#: One notice of every kind, and the licence it names.
EVERY = [
    *NOTICES,
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0 notice"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0 notice"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0 notice"),
    ("Released under the BSD 3-Clause License.", "BSD-3-Clause notice"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0 notice"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0 notice"),
    ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0 notice"),
    ("Released into the public domain under CC0 1.0.", "CC0-1.0 notice"),
    (GPL.split("\n\n")[0], "GPL header"),
]


@pytest.fixture(scope="module")
def places(spark):
    """All matches of each text: the licence, and the text at its place."""

    def found(texts):
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = {r["doc_id"]: r["licences"] for r in licences.licence_scan(frame).collect()}
        return [
            [(m["licence"], text.encode()[m["start"] : m["end"]].decode()) for m in rows[i]] for i, text in enumerate(texts)
        ]

    return found


def test_one_notice_is_one_licence(places):
    texts = [BODY + text + "\n\nThe end of it." for text, _ in EVERY]
    assert places(texts) == [[(licence, text)] for text, licence in EVERY]


def test_a_notice_under_another_line_counts_once(places):
    texts = ["By A Person\n" + text for text, _ in EVERY[:-1]]
    assert [[licence for licence, _ in found] for found in places(texts)] == [[licence] for _, licence in EVERY[:-1]]


def test_every_place_has_its_licence(places):
    text = "\n\nAnd then there is more of the story here.\n".join(text for text, _ in EVERY)
    (found,) = places([text])
    assert [licence for licence, _ in found] == [licence for _, licence in EVERY]


def test_texts_of_several_megabytes(places):
    text = ("A line of a very long story. " * 40 + "\n") * 2000
    (found,) = places([text + "Released under the MIT License.\n" + text + "\n\nAll rights reserved."])
    assert [licence for licence, _ in found] == ["MIT notice", "All rights reserved notice"]


def test_windows_against_all_runs_of_words():
    rng = random.Random(6)
    names = {"A": "a b c d e f", "B": "c a b", "C": "e f a c b d a b"}
    known = licences.Templates(names, 0.8)
    found = 0
    for _ in range(300):
        text = " ".join(rng.choice("abcdefx") if rng.random() < 0.4 else "abcdef"[k % 6] for k in range(rng.randint(1, 24)))
        data = np.frombuffer(text.encode(), np.uint8)
        _, (starts, ends, template, dice) = known.compared(data, np.array([0, len(data)]))
        words = text.split(" ")
        whole = [n for n, t in names.items() if brute.dice(brute.bigrams(text), brute.bigrams(t)) >= 0.8]
        for k, name in enumerate(sorted(names)):
            got = [(text[a:b], d) for a, b, t, d in zip(starts, ends, template, dice) if t == k]
            for part, d in got:
                assert d == brute.dice(brute.bigrams(part), brute.bigrams(names[name]))
            if not whole:
                runs = [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
                top = max((brute.dice(brute.bigrams(r), brute.bigrams(names[name])) for r in runs), default=0)
                assert max((d for _, d in got), default=0) == (top if top >= 0.8 else 0)
                found += top >= 0.8
    assert found > 20
