"""Spelling variants: a trie over the letter-group counts of words, searched with one surplus and one deficit to spend."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm import textbytes as T
from rallyframe.llm.inputs import documents
from rallyframe.session import settle

#: Letters fall into groups by their code point; the levels of the trie begin with the groups of common letters.
GROUPS = 24
COMMON = "eaiotnrslcudpmhgbfywkvxzjq"
LEVELS = list(dict.fromkeys([ord(x) % GROUPS for x in COMMON])) + [
    g for g in range(GROUPS) if g not in {ord(x) % GROUPS for x in COMMON}
]
#: Words of a part of the trie that one task searches, at least; parts of the whole trie, about, at most.
PART_WORDS, PARTS = 1024, 4096
#: Distinct vectors below which a search compares them all; pairs that are verified at a time; longest word in a matrix.
FEW, PAIRS, WIDEST = 8, 1 << 16, 64
#: Bytes of a run whose checksum is worked out for many runs at a time.
SHORT_RUN = 64
IN_RUN = T.table((1, 255))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def _runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, code points, bounds of the rows in them) of the runs of [A-Za-z] and U+00C0 to U+00FF."""
    lead = data == 0xC3
    follows = np.zeros(len(data), np.bool_)
    follows[1:] = lead[:-1]
    letter = (data >= 0x41) & (data <= 0x5A) | (data >= 0x61) & (data <= 0x7A) | lead | follows
    starts, ends, rows = T.word_spans(letter.view(np.uint8), bounds, IN_RUN)
    seen = np.concatenate(([0], np.cumsum(lead)))
    return starts, ends, (ends - starts) - (seen[ends] - seen[starts]), rows


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The crc32 of a prefix, given by its own crc32, and a run."""
    state = prefix ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    live = np.flatnonzero(size <= SHORT_RUN)
    for k in range(SHORT_RUN):
        live = live[size[live] > k]
        if not len(live):
            break
        now = state[live]
        state[live] = CRC[(now ^ data[starts[live] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > SHORT_RUN).tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(prefix[k]))
    return out


def _binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    flat = data[T.ragged(starts, sizes)]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat)])


def counted_words(docs: DataFrame, length: int = 6, least: int = 5, one_in: int = 199) -> DataFrame:
    """word and n: the words of at least `length` letters that occur at least `least` times in all documents.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF; A-Z are lowered. Let h be the crc32 of `<doc_id>:<word>`
    in UTF-8: if `one_in` divides h, the word has lost its code point h % its length. That plants slips of the pen the
    same way in every run; 0 plants none. A null doc_id is written as nothing. Null and empty texts have no words;
    repeated rows count again. Texts are taken in slices of about a MB, a longer text as one slice; each slice sends its
    distinct words with their counts. Other columns are left out. An empty table gives an empty result.
    """
    source = documents(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, end, raw, bounds in T.slices(batch.column("text")):
                data = T.LOWER[raw]
                starts, ends, points, rows = _runs(data, bounds)
                long = points >= length
                slips: list[bytes] = []
                if one_in:
                    prefix = [zlib.crc32(f"{name}:".encode()) for name in names[first:end]]
                    row = np.repeat(np.arange(end - first), np.diff(rows))[long]
                    h = _checksums(data, starts[long], ends[long], np.array(prefix, np.uint32)[row])
                    for k in np.flatnonzero(h % np.uint32(one_in) == 0).tolist():
                        at = np.flatnonzero(long)[k]
                        word = data[starts[at] : ends[at]].tobytes().decode()
                        cut = int(h[k]) % len(word)
                        if len(word) > length:
                            slips.append((word[:cut] + word[cut + 1 :]).encode())
                    kept = np.flatnonzero(long)[h % np.uint32(one_in) != 0]
                else:
                    kept = np.flatnonzero(long)
                prints = T.span_prints(data, starts[kept], ends[kept])
                _, one, n = np.unique(prints, return_index=True, return_counts=True)
                words = _binary(data, starts[kept][one], ends[kept][one])
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])
                if slips:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slips, pa.binary()), pa.array([1] * len(slips), pa.int64())], names=["word", "n"]
                    )

    found = source.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least).select(F.col("word").cast("string").alias("word"), "n")


def group_counts(words: list[bytes]) -> np.ndarray:
    """How many letters of each group the words (one byte a letter) have, in the order of LEVELS; 255 at most.

    What is cut at 255 differs by no more than the counts themselves, so the budget still finds every near word.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64) % GROUPS
    place = np.empty(GROUPS, np.int64)
    place[LEVELS] = np.arange(GROUPS)
    cell = np.repeat(np.arange(len(words)) * GROUPS, sizes) + place[flat]
    counts = np.bincount(cell, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    return np.minimum(counts, 255).astype(np.uint8)


def _spent(probe: np.ndarray, value: int, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probes that can go on, their budgets); bit 0: a surplus is left, bit 1: a deficit."""
    gap = probe.astype(np.int16) - value
    need = np.where(gap == 0, 0, np.where(gap == 1, 1, np.where(gap == -1, 2, 4))).astype(np.uint8)
    on = np.flatnonzero((need & ~budget) == 0)
    return on, budget[on] & ~need[on]


class Parts:
    """The top of the trie: which part of it a vector lies in, and which others its budget reaches."""

    def __init__(self, sizes: dict[bytes, int], limit: int):
        """`sizes`: words below every prefix that is a part."""
        self.first: dict[bytes, tuple[int, int]] = {}
        self.count = 0
        self.root: dict = {}
        for prefix in sorted(sizes):
            blocks = -(-sizes[prefix] // limit) if len(prefix) == GROUPS else 1
            self.first[prefix] = self.count, blocks
            self.count += blocks
            node = self.root
            for value in prefix[:-1]:
                node = node.setdefault(value, {})
            if prefix:
                node[prefix[-1]] = prefix
            else:
                self.root = prefix

    def reached(self, vectors: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, part, whether it lives there): the part of each vector, and those of higher number it may be near to."""
        home = np.full(len(vectors), -1, np.int64)
        found: list[tuple[np.ndarray, int, int]] = []
        stack = [(self.root, 0, np.arange(len(vectors)), np.full(len(vectors), 3, np.uint8))]
        while stack:
            node, level, who, budget = stack.pop()
            if isinstance(node, bytes):
                first, blocks = self.first[node]
                at_home = who[budget == 3]
                home[at_home] = first + salt[at_home] % blocks
                found.append((who, first, blocks))
                continue
            for value, child in node.items():
                on, left = _spent(vectors[who, level], value, budget)
                if len(on):
                    stack.append((child, level + 1, who[on], left))
        who = np.concatenate([np.repeat(own, blocks) for own, _, blocks in found] or [np.empty(0, np.int64)])
        part = np.concatenate(
            [np.tile(np.arange(first, first + blocks), len(own)) for own, first, blocks in found]
            or [np.empty(0, np.int64)]
        )
        keep = part >= home[who]
        return who[keep], part[keep], part[keep] == home[who[keep]]


def _parts(coded: DataFrame, total: int) -> Parts:
    """Prefixes of at most `limit` words, level by level; what comes to the driver is some rows for each of PARTS nodes."""
    limit = max(PART_WORDS, -(-total // PARTS))
    sizes: dict[bytes, int] = {}
    large = {b"": total}
    for level in range(GROUPS + 1):
        sizes |= {p: n for p, n in large.items() if n <= limit or level == GROUPS}
        large = {p: n for p, n in large.items() if n > limit}
        if not large or level == GROUPS:
            break
        nodes = coded.sparkSession.createDataFrame([(bytearray(p),) for p in large], "node binary")
        below = coded.withColumn("node", F.substring("vector", 1, level)) if level else coded.withColumn("node", F.lit(b""))
        found = (
            below.join(F.broadcast(nodes), "node")  # at most total / limit rows
            .groupBy(F.substring("vector", 1, level + 1).alias("prefix"))
            .count()
        )
        large = {bytes(row["prefix"]): row["count"] for row in found.collect()}
    return Parts(sizes, limit)


def _halves(probes: list[int], homes: list[int], words: list[bytes]) -> tuple[list[int], list[int]]:
    """Pairs that may be one edit apart: they agree in the first or the last half of the shorter word."""
    by_size: dict[int, list[int]] = defaultdict(list)
    for h in homes:
        by_size[len(words[h])].append(h)
    left, right = [], []
    for size, own in by_size.items():
        for m in {size // 2, (size - 1) // 2}:
            heads: dict[bytes, list[int]] = defaultdict(list)
            tails: dict[bytes, list[int]] = defaultdict(list)
            for h in own:
                heads[words[h][:m]].append(h)
                tails[words[h][size - m :]].append(h)
            for p in probes:
                if min(len(words[p]), size) // 2 == m and abs(len(words[p]) - size) <= 1:
                    near = {*heads.get(words[p][:m], ()), *tails.get(words[p][len(words[p]) - m :], ())}
                    left += [p] * len(near)
                    right += near
    return left, right


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter turns one word into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


class _Verifier:
    """Checks pairs of words exactly, many at a time."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(min(self.size.max(initial=0), WIDEST)) + 1
        self.matrix = np.zeros((len(words), width), np.uint8)
        short = np.flatnonzero(self.size <= WIDEST)
        flat = np.frombuffer(b"".join(words[k] for k in short.tolist()), np.uint8)
        rows = np.repeat(short, self.size[short])
        self.matrix[rows, T.ragged(np.zeros(len(short), np.int64), self.size[short])] = flat

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        gap = self.size[b] - self.size[a]
        wide = self.size[b] > WIDEST
        x, y = self.matrix[a], self.matrix[b]
        other = x != y
        same_size = (gap == 0) & (other.sum(1) == 1)
        first = other.argmax(1)
        moved = (x[:, :-1] != y[:, 1:]) & (np.arange(x.shape[1] - 1) >= first[:, None])
        out = ~wide & (same_size | (gap == 1) & ~moved.any(1))
        for k in np.flatnonzero(wide).tolist():
            out[k] = one_edit(self.words[a[k]], self.words[b[k]])
        return out


def near_pairs(words: list[bytes], home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, home word) one edit apart: each home word with every other, and each guest with every home word.

    A depth-first search of the trie over the home words' counts carries all words at once, with what is left of their
    budgets; at a leaf the full counts decide, then the letters.
    """
    vectors = group_counts(words)
    homes = np.flatnonzero(home)
    homes = homes[np.lexsort(vectors[homes].T[::-1])]
    sorted_vectors = vectors[homes]
    new = np.ones(len(homes), np.bool_)
    new[1:] = (sorted_vectors[1:] != sorted_vectors[:-1]).any(1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(homes))
    distinct = sorted_vectors[heads]
    verifier = _Verifier(words)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def verify() -> None:
        nonlocal held
        if waiting:
            a, b = (np.concatenate(side) for side in zip(*waiting))
            for at in range(0, len(a), PAIRS):
                good = verifier.near(a[at : at + PAIRS], b[at : at + PAIRS])
                found.append((a[at : at + PAIRS][good], b[at : at + PAIRS][good]))
        waiting.clear()
        held = 0

    def leaf(k: int, who: np.ndarray) -> None:
        nonlocal held
        own = homes[heads[k] : tails[k]]
        if len(who) * len(own) <= PAIRS:
            a, b = np.repeat(who, len(own)), np.tile(own, len(who))
        else:
            a, b = (np.array(side, np.int64) for side in _halves(who.tolist(), own.tolist(), words))
        once = ~home[a] | (a < b)
        a, b = a[once], b[once]
        waiting.append((a, b))
        held += len(a)
        if held > 4 * PAIRS:
            verify()

    stack = [(0, 0, len(heads), np.arange(len(words)), np.full(len(words), 3, np.uint8))]
    while stack:
        level, low, high, who, budget = stack.pop()
        if high - low <= FEW or level == GROUPS:
            for k in range(low, high):
                gap = vectors[who, level:].astype(np.int16) - distinct[k, level:]
                more, less = np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1)
                on = (more <= (budget & 1)) & (less <= (budget >> 1))
                if on.any():
                    leaf(k, who[on])
            continue
        column = distinct[low:high, level]
        cuts = np.flatnonzero(np.diff(column)) + 1
        edges = [low, *(low + cuts).tolist(), high]
        probe = vectors[who, level]
        for a, b in zip(edges[:-1], edges[1:]):
            on, left = _spent(probe, int(distinct[a, level]), budget)
            if len(on):
                stack.append((level + 1, a, b, who[on], left))
    verify()
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*found))


def _searched(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """word, n_near, best_n and best of the words of one part that have near words there."""
    rows = rows.sort_by("word")  # code-point order, so a smaller place is a smaller word
    text = rows.column("word").to_pylist()
    words = [x.encode("latin-1") for x in text]
    n = rows.column("n").to_numpy()
    a, b = near_pairs(words, rows.column("home").to_numpy(zero_copy_only=False))
    left, right = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.lexsort((right, -n[right], left))
    left, right = left[order], right[order]
    who, first, times = np.unique(left, return_index=True, return_counts=True)
    best = right[first]
    return pa.table(
        {
            "word": pa.array([text[k] for k in who.tolist()], pa.string()),
            "n_near": pa.array(times, pa.int64()),
            "best_n": pa.array(n[best], pa.int64()),
            "best": pa.array([text[k] for k in best.tolist()], pa.string()),
        }
    )


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best_n and best of every word of `vocabulary` (word, n; distinct words) that has near words.

    Near words differ by one inserted, deleted or replaced code point; `best` is the one of largest n, of equals the
    smallest in code-point order. Words must be of code points up to U+00FF.

    The top of the trie, some thousand parts at most, is known to all tasks. A word goes to its part and to the parts of
    higher number that its budget reaches, so each pair meets once, where the first of its parts' words visit the
    second's. A part holds about a 4,096th of the words at most; words that share all counts beyond that are split into
    blocks. Each part sends one row for each word, never its pairs.
    """
    coded = vocabulary.select("word", "n")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = group_counts([x.encode("latin-1") for x in batch.column("word").to_pylist()])
            blobs = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(GROUPS), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors))]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), blobs.cast(pa.binary())], names=["word", "n", "vector"]
            )

    coded = settle(coded.mapInArrow(code, "word string, n long, vector binary"))
    parts = _parts(coded, coded.count())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.uint8).reshape(-1, GROUPS)
            words = batch.column("word").to_pylist()
            salt = np.fromiter((zlib.crc32(x.encode()) for x in words), np.int64, len(words))
            who, part, home = parts.reached(vectors, salt)
            for at in range(0, len(who), PAIRS):
                own = pa.array(who[at : at + PAIRS])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[at : at + PAIRS], pa.int64()),
                        batch.column("word").take(own),
                        batch.column("n").take(own),
                        pa.array(home[at : at + PAIRS]),
                    ],
                    names=["part", "word", "n", "home"],
                )

    routed = coded.mapInArrow(route, "part long, word string, n long, home boolean")
    partial = routed.groupBy("part").applyInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return (
        partial.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("top"))
        .select("word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best"))
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """word and root, the end of its chain, for every `word` with a `form`; every round doubles the steps taken."""
    now = settle(forms.select("word", F.col("form").alias("to")))
    while True:
        jump = now.select(F.col("word").alias("to"), F.col("to").alias("far"))
        moved = settle(now.join(jump, "to", "left").select("word", F.coalesce("far", "to").alias("to"), "far"))
        now = moved.select("word", "to")
        if moved.filter("far IS NOT NULL").isEmpty():
            return now.withColumnRenamed("to", "root")


def spelling_variants(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of `vocabulary` (word, n).

    A word's form is its best near word (see `near_words`) if that occurs at least `times` as often, else null; root
    follows forms to the last, and is the word itself if it has none. Forms are ever more frequent, so chains end, after
    a number of steps that follows the logarithm of the largest count. An empty vocabulary gives an empty result.
    """
    words = settle(vocabulary.select("word", "n"))
    near = settle(near_words(words))
    judged = words.join(near, "word", "left").withColumn("takes", F.col("best_n") >= times * F.col("n"))
    forms = settle(judged.filter("takes").select("word", F.col("best").alias("form")))
    return (
        judged.join(last_forms(forms), "word", "left")
        .select(
            "word",
            F.when(F.col("takes"), F.col("best")).alias("form"),
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("takes"), F.col("best_n")).alias("form_n"),
        )
    )
