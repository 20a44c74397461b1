"""Licence notices in texts: Dice coefficient of word bigrams against templates."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm import textbytes as T
from rallyframe.llm.decontaminate import words_of
from rallyframe.llm.inputs import documents, result_schema, unpacked

#: Wording of public licences and of the notices that name them.
TEMPLATES: dict[str, str] = {
    "MIT notice": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "BSD text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0 notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0 notice": "Released into the public domain under CC0 1.0.",
    "All rights reserved notice": "All rights reserved.",
    "Proprietary notice": "All rights reserved. No part of this work may be reproduced without written permission.",
}
RESULTS = ["doc_id", "n_segments", "licences", "best_licence", "best_dice"]


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of what is compared: every line, and every stretch of lines without a blank one."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate((bounds[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    row = np.searchsorted(bounds, starts, side="right") - 1
    stops = np.append(breaks, len(data))
    ends = np.minimum(stops[np.searchsorted(stops, starts)], bounds[row + 1])
    seen = np.concatenate(([0], np.cumsum(T.NOT_SPACE[data])))
    full = seen[ends] > seen[starts]
    opens = full.copy()
    opens[1:] &= ~full[:-1] | (row[1:] != row[:-1])
    closes = full.copy()
    closes[:-1] &= ~full[1:] | (row[1:] != row[:-1])
    block_starts, block_ends = starts[opens], ends[closes]
    several = np.flatnonzero(closes) > np.flatnonzero(opens)
    return (
        np.concatenate((starts[full], block_starts[several])),
        np.concatenate((ends[full], block_ends[several])),
    )


class Templates:
    """The distinct bigrams of every template as sorted fingerprints with the templates that have each."""

    def __init__(self, texts: Mapping[str, str], threshold: float):
        self.names = sorted(texts)
        raw = [texts[name].encode() for name in self.names]
        prints, _, _, rows = words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        starts, owner = T.window_starts(rows, 2)
        grams = T.window_prints(prints, 2)[starts]
        pairs = np.unique(np.stack((grams, owner.astype(np.uint64))), axis=1)
        self.grams, self.begin = np.unique(pairs[0], return_index=True)
        self.begin = np.append(self.begin, pairs.shape[1])
        self.owner = pairs[1].astype(np.int64)
        self.sizes = np.bincount(self.owner, minlength=len(self.names))
        self.threshold = threshold
        # 2 * shared / (n + m) can only reach the threshold if n lies between these
        self.least = np.ceil(threshold / (2 - threshold) * self.sizes - 1e-9)
        self.most = np.floor((2 - threshold) / threshold * self.sizes + 1e-9)
        self.maybe = np.zeros(1 << 16, np.bool_)
        self.maybe[(self.grams >> np.uint64(48)).astype(np.int64)] = True
        #: Bigrams a window may have; a template counts here with its repeats.
        self.reach = np.floor((2 - threshold) / threshold * np.bincount(owner, minlength=len(self.names)) + 1e-9).astype(np.int64)
        #: Which bigrams each template has; the last column is no bigram of any.
        self.has = np.zeros((len(self.names), len(self.grams) + 1), np.bool_)
        self.has[self.owner, np.repeat(np.arange(len(self.grams)), np.diff(self.begin))] = True

    def compared(self, data: np.ndarray, bounds: np.ndarray):
        """(segments of each row, and for each match: start, end, template, Dice coefficient)."""
        prints, word_starts, word_ends, rows = words_of(data, bounds)
        starts, ends = segments(data, bounds)
        row = np.searchsorted(bounds, starts, side="right") - 1
        counts = np.bincount(row, minlength=len(bounds) - 1)
        none = (np.empty(0, np.int64),) * 3 + (np.empty(0),)
        first = np.searchsorted(word_starts, starts)
        last = np.searchsorted(word_starts, ends)
        n = np.maximum(last - first - 1, 0)
        grams = T.window_prints(prints, 2)
        if not len(grams) or not len(self.grams):
            return counts, none
        known = self.maybe[(grams >> np.uint64(48)).astype(np.int64)]
        spot = np.minimum(np.searchsorted(self.grams, grams[known]), len(self.grams) - 1)
        number = np.full(len(grams), -1, np.int64)
        number[known] = np.where(self.grams[spot] == grams[known], spot, -1)
        number[rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] <= len(grams))] - 1] = -1  # across two rows
        who, template, dice = self.whole(first, n, grams, number)
        begin, end, name, close = self.inside(first[who], n[who], template, grams, number, rows)
        return counts, (
            np.concatenate((starts[who], word_starts[begin])),
            np.concatenate((ends[who], word_ends[end])),
            np.concatenate((template, name)),
            np.concatenate((dice, close)),
        )

    def whole(self, first: np.ndarray, n: np.ndarray, grams: np.ndarray, number: np.ndarray):
        """(segment, template, Dice coefficient) of the segments, by first bigram and count, that match as they are."""
        none = (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        # only segments with a bigram of some template, within the loosest size bounds (repeats only add to n)
        hits = np.concatenate(([0], np.cumsum(number >= 0)))
        some = np.flatnonzero((n >= self.least.min()) & (hits[first + n] > hits[first]))
        if not len(some):
            return none
        at = T.ragged(first[some], n[some])
        pair = np.stack((np.repeat(some, n[some]).astype(np.uint64), grams[at]))
        order = np.lexsort(pair[::-1])
        ordered = pair[:, order]
        fresh = np.concatenate(([True], (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)))
        segment, gram = ordered[0][fresh].astype(np.int64), number[at[order[fresh]]]
        distinct = np.bincount(segment, minlength=len(first))
        shared = gram >= 0
        segment, gram = segment[shared], gram[shared]
        owners = self.begin[gram + 1] - self.begin[gram]
        who = np.repeat(segment, owners)
        template = self.owner[T.ragged(self.begin[gram], owners)]
        fits = (distinct[who] >= self.least[template]) & (distinct[who] <= self.most[template])
        couple, common = np.unique(who[fits] * len(self.names) + template[fits], return_counts=True)
        who, template = couple // len(self.names), couple % len(self.names)
        dice = 2 * common / (distinct[who] + self.sizes[template])
        good = dice >= self.threshold
        return who[good], template[good], dice[good]

    def inside(self, first, n, template, grams: np.ndarray, number: np.ndarray, rows: np.ndarray):
        """(first word, last word, template, Dice coefficient) of windows of words in what whole segments left over.

        `first`, `n` and `template` are the segments that matched: the bigrams they share with their template count for
        no window. Of windows of one template that overlap, the most similar one stays, of equals the first. The most
        similar window begins and ends with a bigram of its template, so only those are asked.
        """
        size = len(grams)
        left = number
        for t in np.unique(template):
            mine = template == t
            change = np.bincount(first[mine], minlength=size + 1) - np.bincount(first[mine] + n[mine], minlength=size + 1)
            left = np.where((np.cumsum(change[:size]) > 0) & self.has[t, number], -1, left)
        at = np.flatnonzero(left >= 0)
        stop = rows[np.searchsorted(rows, at, side="right")] - 1  # the first bigram that leaves the row
        found = [(np.empty(0, np.int64),) * 3 + (np.empty(0),)]
        for t in range(len(self.names)):
            own = self.has[t, left[at]]
            p, limit = at[own], np.minimum(stop[own], at[own] + self.reach[t])
            # as many bigrams of the template as the least Dice coefficient needs, repeats included
            many = np.searchsorted(p, limit) - np.arange(len(p)) >= max(self.least[t], 1)
            p, limit = p[many], limit[many]
            if len(p):
                found.append(self.best_windows(t, p, limit, grams, left))
        return tuple(np.concatenate(x) for x in zip(*found))

    def best_windows(self, t: int, p: np.ndarray, limit: np.ndarray, grams: np.ndarray, left: np.ndarray):
        """The windows of template t that begin at `p`, end before `limit`, and are similar enough."""
        # the place before at which a bigram has been last, for distinct counts from any start
        change = np.bincount(p, minlength=len(grams) + 1) - np.bincount(limit, minlength=len(grams) + 1)
        near = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        order = near[np.argsort(grams[near], kind="stable")]
        same = grams[order[1:]] == grams[order[:-1]]
        past = np.full(len(grams), -1, np.int64)
        past[order[1:][same]] = order[:-1][same]
        ends, dices = [], []
        step = max(1, (1 << 20) // int(self.reach[t]))
        for k in range(0, len(p), step):
            begin = p[k : k + step, None]
            cell = begin + np.arange(self.reach[t])
            valid = cell < limit[k : k + step, None]
            cell = np.where(valid, cell, 0)
            fresh = valid & (past[cell] < begin)
            common = np.cumsum(fresh & self.has[t, left[cell]], axis=1)
            dice = np.where(valid, 2 * common / (np.cumsum(fresh, axis=1) + self.sizes[t]), 0)
            last = dice.argmax(axis=1)
            ends.append(begin[:, 0] + last)
            dices.append(dice[np.arange(len(last)), last])
        end, dice = np.concatenate(ends), np.concatenate(dices)
        used, chosen = np.zeros(len(grams), np.bool_), []
        for k in np.lexsort((p, -dice)).tolist():
            if dice[k] < self.threshold:
                break
            if not used[p[k] : end[k] + 1].any():
                used[p[k] : end[k] + 1] = True
                chosen.append(k)
        return p[chosen], end[chosen] + 1, np.full(len(chosen), t, np.int64), dice[chosen]

    def winners(self, starts: np.ndarray, ends: np.ndarray, template: np.ndarray, dice: np.ndarray) -> np.ndarray:
        """Which matches stay, in order of place: of those that overlap the most similar one is taken first.

        Of equally similar ones that of the larger template comes first, then the shorter place, then the first name.
        """
        taken: list[tuple[int, int, int]] = []  # start, end, match: apart from each other and in order
        for k in np.lexsort((starts, template, ends - starts, -self.sizes[template], -dice)).tolist():
            own = (int(starts[k]), int(ends[k]), k)
            at = bisect(taken, own)
            if (at == 0 or taken[at - 1][1] <= own[0]) and (at == len(taken) or own[1] <= taken[at][0]):
                taken.insert(at, own)
        return np.array([k for _, _, k in taken], np.int64)


def licence_scan(
    docs: DataFrame,
    templates: Mapping[str, str] | None = None,
    threshold: float = 0.8,
    carry: Iterable[str] = (),
) -> DataFrame:
    """doc_id, n_segments, licences (licence, dice, start, end in bytes), best_licence and best_dice.

    Every line of a text, and every stretch of lines without a blank one between, is normalised to its words (runs of
    letters, digits and bytes beyond ASCII, A-Z lowered) and compared with each template whose size allows a Dice
    coefficient of distinct word bigrams of at least `threshold`. A notice inside a longer line or stretch, or wrapped in
    comment marks, is found as a window: any run of a text's words, over line ends too, that reaches the threshold with
    bigrams that no whole line or stretch has matched with; `n_segments` does not count windows. Matches that overlap
    compete, so a place in a text names one licence: the most similar one, of equals that of the larger template, then
    the shorter place, then the first name. Matches come by place; the best is the one with the largest coefficient, of
    equals the first by name. Segments of one word have no bigram and never match.

    Null and empty texts have no segments. Texts of any length are compared whole. Repeated rows stay; other columns
    than `carry` are left out, so their names cannot clash; an empty table gives an empty result.
    """
    known = Templates(TEMPLATES if templates is None else templates, threshold)
    source = documents(docs, carry, RESULTS)
    match = pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, bounds in T.slices(batch.column("text"), 1 << 20):
                counts, (starts, ends, template, dice) = known.compared(data, bounds)
                order = known.winners(starts, ends, template, dice)
                row = np.searchsorted(bounds, starts[order], side="right") - 1
                names = pa.array(known.names, pa.string()).take(pa.array(template[order], pa.int64()))
                found = pa.StructArray.from_arrays(
                    [
                        names,
                        pa.array(dice[order], pa.float64()),
                        pa.array(starts[order] - bounds[row], pa.int64()),
                        pa.array(ends[order] - bounds[row], pa.int64()),
                    ],
                    fields=list(match),
                )
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(bounds))), pa.int32()), found)
                kept = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [kept.column("doc_id"), pa.array(counts, pa.int64()), lists, *kept.columns[2:]],
                    names=["doc_id", "n_segments", "licences", *kept.schema.names[2:]],
                )

    kept = ["carried"] if "carried" in source.columns else []
    found = "licences array<struct<licence: string, dice: double, start: long, end: long>>"
    rows = source.mapInArrow(scan, result_schema(source, f"n_segments long, {found}"))
    ranked = F.array_sort(F.transform("licences", lambda m: F.struct((-m["dice"]).alias("d"), m["licence"].alias("licence"))))
    best = F.try_element_at(ranked, F.lit(1))
    judged = rows.withColumn("best_licence", best["licence"]).withColumn("best_dice", -best["d"])
    return unpacked(judged.select(*RESULTS, *kept))
