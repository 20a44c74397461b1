"""Near-duplicate documents: banded MinHash candidates, odd sketches to verify them, full sets to confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.llm import textbytes as T
from rallyframe.llm.components import components, hot_keys, repeated, spread
from rallyframe.llm.inputs import documents
from rallyframe.session import settle

#: A pair at similarity 0.8 shares no band of 6 rows among 56 with a chance of (1 - 0.8^6)^56 = 4e-8.
BANDS, ROWS = 56, 6
#: Bits of an odd sketch; how far below the threshold an estimate still counts, over five standard errors.
SKETCH_BITS, SLACK = 1024, 0.15
WORDS = SKETCH_BITS // 64
#: Pairs with one hub that lie in one block; bits of a cell of shingles.
HUB_BLOCK, CELL_BITS = 256, 18


def shingle_prints(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of the distinct shingles of each row, sorted; their bounds). A-Z are lowered.

    A row of fewer words than `size` has one shingle, its whole sequence; one without words has none.
    """
    lowered = T.LOWER[data]
    starts, ends, words = T.word_spans(lowered, bounds, T.NOT_SPACE)
    prints = T.span_prints(lowered, starts, ends)
    whole = T.window_prints(prints, size)
    n_words = np.diff(words)
    out = []
    for a, n in zip(words[:-1].tolist(), n_words.tolist()):
        if n >= size:
            own = np.sort(whole[a : a + n - size + 1])
            head = np.ones(len(own), np.bool_)
            np.not_equal(own[1:], own[:-1], out=head[1:])
            out.append(own[head])
        elif n:
            out.append(T.window_prints(prints[a : a + n], n) ^ np.uint64(n))
        else:
            out.append(np.empty(0, np.uint64))
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def _constants(n: int, seed: int) -> np.ndarray:
    return T.mixed((np.arange(n, dtype=np.uint64) + np.uint64(seed)) * T.LANE)


def minhashes(prints: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS * ROWS least rehashes of each non-empty row, one column for each row."""
    samples = BANDS * ROWS
    factors = (_constants(samples, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shifts = (_constants(samples, 1 << 20) >> np.uint64(32)).astype(np.uint32)
    halves = ((prints >> np.uint64(32)).astype(np.uint32), prints.astype(np.uint32))
    out = np.empty((samples, len(bounds) - 1), np.uint32)
    for k in range(samples):
        out[k] = np.minimum.reduceat(halves[k % 2] * factors[k] + shifts[k], bounds[:-1])
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys of the bands."""
    keys = np.empty((least.shape[1], BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(least.shape[1], band + 1, np.uint64)
        for row in range(ROWS):
            key = T.mixed(key * T.STEP + least[band * ROWS + row].astype(np.uint64))
        keys[:, band] = key
    return keys


def _parities(place: np.ndarray, rows: int) -> np.ndarray:
    """(rows, WORDS) bitmaps; every place in `row * SKETCH_BITS + bit` flips that bit."""
    odd = (np.bincount(place, minlength=rows * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8").reshape(rows, WORDS)


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the MinHash samples: each flips the bit that its number and value choose."""
    samples, rows = least.shape
    number = (np.arange(samples, dtype=np.uint64) + np.uint64(1)) << np.uint64(32)
    bit = T.mixed(least.astype(np.uint64) | number[:, None]) % np.uint64(SKETCH_BITS)
    return _parities((bit.astype(np.int64) + np.arange(rows) * SKETCH_BITS).reshape(-1), rows)


def set_parities(prints: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the whole sets: two of them differ in at most as many bits as the sets differ in shingles."""
    rows = len(bounds) - 1
    bit = (T.mixed(prints ^ T.LANE) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return _parities(bit + np.repeat(np.arange(rows) * SKETCH_BITS, np.diff(bounds)), rows)


def _flips(a: Column, b: Column, first: int) -> Column:
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(first, first + WORDS)), F.lit(0))


def plausible(n_a: Column, n_b: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether two classes may be similar enough, from their sizes and bitmaps (of samples, then of sets).

    Sizes and the bitmaps of the sets bound the similarity from above: those bounds lose nothing. The XOR of the odd
    sketches estimates it: -1/2 ln(1 - 2 flips / bits) / ln(1 - 2 / bits) of the samples differ.
    """
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    differ, both = _flips(a, b, WORDS), n_a + n_b
    bound = 100 * (both - differ) >= percent * (both + differ)
    rest = F.greatest(F.lit(1e-9), 1 - _flips(a, b, 0) * (2.0 / SKETCH_BITS))
    differing = F.log(rest) / float(np.log(1 - 2 / SKETCH_BITS)) / 2
    return sizes & bound & (1 - differing / (BANDS * ROWS) >= percent / 100 - SLACK)


def _lists(table: np.ndarray) -> pa.Array:
    flat = pa.array(table.reshape(-1))
    return pa.FixedSizeListArray.from_arrays(flat, table.shape[1]).cast(pa.list_(pa.int64()))


def _signatures(source: DataFrame, size: int) -> DataFrame:
    """doc_id, n, set_a, set_b, bands and sketch of every document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id")
            for first, end, data, bounds in T.slices(batch.column("text"), 1 << 18):
                prints, own = shingle_prints(data, bounds, size)
                n = np.diff(own)
                full = np.flatnonzero(n)
                bands = np.zeros((len(n), BANDS), np.int64)
                sketch = np.zeros((len(n), 2 * WORDS), np.int64)
                sums = np.zeros((2, len(n)), np.int64)
                if len(full):
                    heads = np.append(own[:-1][full], own[-1])
                    least = minhashes(prints, heads)
                    bands[full] = band_keys(least).view(np.int64)
                    sketch[full, :WORDS] = odd_sketches(least).view(np.int64)
                    sketch[full, WORDS:] = set_parities(prints, heads).view(np.int64)
                    for k, seed in enumerate((T.SECOND, T.STEP)):
                        sums[k][full] = np.add.reduceat(T.mixed(prints ^ seed), heads[:-1]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(first, end - first),
                        pa.array(n, pa.int64()),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        _lists(bands),
                        _lists(sketch),
                    ],
                    names=["doc_id", "n", "set_a", "set_b", "bands", "sketch"],
                )

    schema = "doc_id long, n long, set_a long, set_b long, bands array<long>, sketch array<long>"
    return source.mapInArrow(sign, schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs `a`, `b` whose full shingle sets are similar enough.

    Pairs with one `b` lie together in blocks of HUB_BLOCK: the text of `b` comes once for each block, followed by those
    of its partners, which stream by. No row has two texts, no task needs a whole group, and a `b` with very many
    partners is dealt over as many places as it has blocks.
    """
    pairs = settle(pairs.select("a", "b"))
    hubs = settle(pairs.groupBy("b").agg(F.expr(f"count(*) div {HUB_BLOCK} + 1").cast("int").alias("blocks")))
    many = settle(hubs.filter("blocks > 1"))
    block = F.pmod(F.xxhash64("a"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block")
    partners = pairs.join(many, "b", "left").select("b", block, "a")
    with_texts = partners.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("b", "block", "a", "text")
    own = hubs.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("a"), "text"
    )
    rows = with_texts.union(own).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, prints = None, np.empty(0, np.uint64)
        for batch in batches:
            good = np.zeros(len(batch), np.bool_)
            names = list(zip(batch.column("b").to_pylist(), batch.column("a").to_pylist()))
            for first, _, data, bounds in T.slices(batch.column("text"), 1 << 18):
                sets, ends = shingle_prints(data, bounds, size)
                for k, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()), first):
                    b, a = names[k]
                    if a is None:
                        hub, prints = b, sets[low:high].copy()
                        continue
                    if hub != b:
                        raise ValueError(f"{a} came before the text of {b}")
                    both = len(np.intersect1d(prints, sets[low:high], assume_unique=True))
                    good[k] = both > 0 and 100 * both >= percent * (len(prints) + high - low - both)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"]
            )

    return rows.mapInArrow(confirm, "a long, b long")


def _rare_shingles(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id and shingle: the rarest shingles of each text, so many that two similar enough texts have one in common.

    Of n shingles in one order for all texts, sets that are alike to p percent share one among the first n - pn + 1 of
    both. The order is by how many shingles fall into a shingle's cell of 2^18, least first: the counts of cells have a
    fixed size, and any order of all shingles does.
    """

    def cells(prints: np.ndarray) -> np.ndarray:
        return (T.mixed(prints ^ T.SECOND) >> np.uint64(64 - CELL_BITS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for _, _, data, bounds in T.slices(batch.column("text"), 1 << 18):
                total += np.bincount(cells(shingle_prints(data, bounds, size)[0]), minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["cell", "n"])

    every = np.zeros(1 << CELL_BITS, np.int64)
    counted = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cell_counts = counted.toArrow()  # at most 2^18 rows of two numbers, 4 MB
    every[cell_counts.column("cell").to_numpy()] = cell_counts.column("n").to_numpy()
    # of equal counts the order of cells, and in a cell that of the shingles
    place = np.empty(len(every), np.int32)
    place[np.argsort(every, kind="stable")] = np.arange(len(every), dtype=np.int32)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id")
            for first, _, data, bounds in T.slices(batch.column("text"), 1 << 18):
                prints, ends = shingle_prints(data, bounds, size)
                rank = place[cells(prints)]
                rows, out = [], []
                for k, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()), first):
                    n = high - low
                    order = np.lexsort((prints[low:high], rank[low:high]))
                    out.append(prints[low:high][order[: n - -(-percent * n // 100) + 1]])
                    rows += [k] * len(out[-1])
                found = np.concatenate(out) if out else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(rows, pa.int64())), pa.array(found.view(np.int64))], names=["doc_id", "shingle"]
                )

    return texts.select("doc_id", "text").mapInArrow(rarest, "doc_id long, shingle long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if 100 * intersection >= percent * union of their sets of `size`-word shingles (A-Z lowered,
    words between ASCII white space; fewer words are one shingle). component_id is the least doc_id that links reach.

    Equal sets are one class from the start. MinHash samples of each class give band keys and, folded by parity, an odd
    sketch; a second bitmap folds the whole set. Classes with a band in common are candidates: first each with the most
    connected member of its buckets. Of texts whose buckets are still in different components the rarest shingles are
    listed, of which two similar enough texts must share one: those that share none with another component are done, so
    texts that are alike but not enough, however many, cost what listing them costs. The others meet the most connected
    member of every bucket, and then those that are still apart each other, as far as sizes and bitmaps allow.
    A candidate passes if sizes and bitmaps let it, and counts if the full sets say so. All pairs of a bucket are thereby
    decided or known to be connected.

    Documents without words are linked with nothing, and so are null ids, which are kept. Rows that share an id are one
    document with several texts. Repeated rows stay. An empty table gives an empty result.
    """
    source = documents(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = settle(_signatures(source, size))
    named = signed.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "set_a", "set_b")
    classes = settle(named.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("node")))
    of_class = ["set_a", "set_b", "n", "doc_id"]
    nodes = signed.join(classes.withColumnRenamed("node", "doc_id"), of_class, "left_semi").select(
        F.col("doc_id").alias("node"), "n", "bands", "sketch"
    )
    entries = nodes.select("node", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(
        F.count("*").alias("members"), F.min("node").alias("least"), F.max("node").alias("most")
    )
    shared = settle(entries.join(buckets.filter("least < most").select("key", "members"), "key"))
    central = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    described = settle(nodes.join(central, "node").select("node", "n", "sketch", "weight"))
    texts = settle(source.join(described.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"))

    def likely(pairs: DataFrame) -> DataFrame:
        a = described.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        b = described.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        near = plausible(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"), percent)
        pairs = settle(pairs.distinct())
        hot = hot_keys(pairs, "b")
        dealt = spread(pairs.join(a, "a"), hot, "b", by="a")
        return dealt.join(repeated(b, hot, "b"), ["b", "share"]).filter(near).select("a", "b")

    hub = F.max(F.struct("weight", (-F.col("node")).alias("minus")))
    hubs = shared.join(described.select("node", "weight"), "node").groupBy("key").agg(hub.alias("hub"))
    spokes = settle(
        shared.join(hubs, "key")
        .select("node", (-F.col("hub.minus")).alias("b"), F.col("hub.weight").alias("weight"))
        .filter("node != b")
        .distinct()
    )
    # each member with the best of its hubs first: in a large group that leaves few pairs between components
    best = spokes.groupBy(F.col("node").alias("a")).agg(F.max_by("b", F.struct("weight", -F.col("b"))).alias("b"))
    links = settle(_confirmed(likely(best), texts, size, percent))
    reached = components(links)

    def placed(entries: DataFrame) -> DataFrame:
        own = entries.select("key", "node").join(reached, "node", "left")
        return own.select("key", "node", F.coalesce("component", "node").alias("component"))

    def still_open(rows: DataFrame, members: int) -> DataFrame:
        """Keys with members in different components."""
        ends = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
        return rows.join(ends.filter(f"x < y AND n >= {members}").select("key"), "key", "left_semi")

    # of the texts in buckets that are not yet one component, only those that share a rare shingle with another component
    undecided = settle(still_open(placed(shared), 2).select(F.col("node").alias("doc_id"), "component").distinct())
    listed = _rare_shingles(texts.join(undecided, "doc_id", "left_semi"), size, percent).join(undecided, "doc_id")
    listed = listed.select(F.col("shingle").alias("key"), F.col("doc_id").alias("node"), "component")
    alive = settle(still_open(settle(listed), 2).select("node").distinct())
    side_a = reached.select(F.col("node").alias("a"), F.col("component").alias("x"))
    side_b = reached.select(F.col("node").alias("b"), F.col("component").alias("y"))
    ends = spokes.select(F.col("node").alias("a"), "b").join(alive.select(F.col("node").alias("a")), "a", "left_semi")
    hot = hot_keys(ends, "b")
    both = repeated(alive.select(F.col("node").alias("b")).join(side_b, "b", "left"), hot, "b")
    apart = (
        spread(ends.join(side_a, "a", "left"), hot, "b", by="a")
        .join(both, ["b", "share"])
        .filter(F.coalesce("x", "a") != F.coalesce("y", "b"))
        .select("a", "b")
    )
    links = settle(links.union(_confirmed(likely(apart), texts, size, percent)))
    reached = components(links)
    # what is left: members of one bucket in different components; a bucket of two has nothing but its hub
    # plain columns that are never null keep the join's condition small enough to be compiled
    parity = [F.coalesce(F.col("sketch")[WORDS + k], F.lit(0)).alias(f"p{k}") for k in range(WORDS)]
    rest = (
        still_open(settle(placed(shared.join(alive, "node", "left_semi"))), 2)
        .join(described.select("node", F.coalesce("n", F.lit(0)).alias("n"), *parity), "node")
        .select("key", "node", "component", "n", *[f"p{k}" for k in range(WORDS)])
    )
    left, right = rest.alias("l"), rest.alias("r")
    differ = sum((F.bit_count(F.col(f"l.p{k}").bitwiseXOR(F.col(f"r.p{k}"))) for k in range(WORDS)), F.lit(0))
    sizes = F.col("l.n") + F.col("r.n")
    others = left.join(
        right,
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.node") < F.col("r.node"))
        & (F.col("l.component") != F.col("r.component"))
        & (100 * (sizes - differ) >= percent * (sizes + differ)),
    ).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    second = _confirmed(likely(others), texts, size, percent)
    # an id with several texts ties their classes together
    copies = settle(named.distinct())
    of_set = ["set_a", "set_b", "n"]
    hot = hot_keys(copies, *of_set)
    member = (
        spread(copies, hot, *of_set, by="doc_id").join(repeated(classes, hot, *of_set), [*of_set, "share"]).select("doc_id", "node")
    )
    own = settle(member.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("other")))
    ties = (
        member.join(own.filter("node < other").select("doc_id", F.col("node").alias("a")), "doc_id")
        .filter("node != a")
        .select("a", F.col("node").alias("b"))
    )
    final = components(settle(links.union(second).union(ties)))
    found = own.join(final, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
