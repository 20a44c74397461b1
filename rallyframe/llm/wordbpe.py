"""A word-level BPE tokenizer over whole batches: each distinct piece is merged once, all pieces together.

The file is one of the `tokenizers` library whose pieces never cross white space. Its normaliser, splitting pattern
and merges are read from the file. Chunks of plain ASCII and Latin letters are split and merged here, many at a time; all others
(other scripts, control characters, apostrophes, very long runs, the text of an added token) go to the library itself,
with its default settings: the ids are its own.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from rallyframe.llm import textbytes as T

#: Bytes of the longest piece that is merged here.
LONGEST = 48
#: Places of the workers' memory of pieces, and the ids it holds before it is emptied.
PLACES_BITS, REMEMBERED = 20, 4_000_000
#: The splitting pattern that _pieces follows; fixed by the tokenizer's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, OTHER, HARD = range(5)


def _byte_classes() -> np.ndarray:
    """White space, letters, digits and other printable ASCII; 0xC3 and its followers are letters; the rest is hard."""
    kind = np.full(256, HARD, np.uint8)
    kind[0x21:0x7F] = OTHER
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[0x30:0x3A] = DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = LETTER
    kind[0x80:0xC0] = kind[0xC3] = LETTER
    kind[0x27] = HARD  # an apostrophe may begin a contraction
    return kind


KINDS = _byte_classes()


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = dict(zip(shown, map(chr, shown))) | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class WordBPE:
    """ids(texts): the token ids of every text, one after the other, and where each text's begin."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, splits = said["model"], said["pre_tokenizer"]["pretokenizers"]
        steps = [step["type"] for step in said["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or splits[0]["type"] != "Split" or model["type"] != "BPE":
            raise ValueError(f"{path}: not a lower-casing BPE that drops white space")
        self.library = Tokenizer.from_file(path)
        self.added = [token["content"].encode() for token in said["added_tokens"]]
        if splits[0]["pattern"]["Regex"] != PATTERN:
            raise ValueError(f"{path}: another splitting pattern")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + suffix] for x in letters], np.int64)
        self._merges(vocab, model["merges"])
        self._forget()

    def _merges(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._hash(keys, made)

    def _forget(self) -> None:
        self.prints = np.zeros(1 << PLACES_BITS, np.uint64)
        self.index = np.zeros(1 << PLACES_BITS, np.int32)
        self.flat = np.empty(0, np.uint16)
        self.begins = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)

    def _hash(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Merge ranks in an open table: two probes of 2^20 places hold nearly all keys; the rest is searched."""
        self.bits = np.uint64(64 - 20)
        self.made = made
        self.slots = np.full(1 << 20, -1, np.int64)
        self.ranks = np.full(1 << 20, len(keys), np.int32)
        at = self._place(keys)
        self.ranks[at[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.slots[at[::-1]] = keys[::-1]
        lost = self.slots[at] != keys
        order = np.argsort(keys[lost])
        self.lost_keys, self.lost_ranks = keys[lost][order], np.flatnonzero(lost)[order].astype(np.int32)
        self.crowded = np.zeros(1 << 20, np.bool_)
        self.crowded[at[lost]] = True

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * T.LANE) >> self.bits).astype(np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges if there is none."""
        at = self._place(keys)
        rank = np.where(self.slots[at] == keys, self.ranks[at], np.int32(len(self.made)))
        if len(again := np.flatnonzero(self.crowded[at] & (rank == len(self.made)))):
            spot = np.minimum(np.searchsorted(self.lost_keys, keys[again]), len(self.lost_keys) - 1)
            found = self.lost_keys[spot] == keys[again]
            rank[again[found]] = self.lost_ranks[spot[found]]
        return rank

    def _merged(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pieces that follow each other: in every round each makes its first merge of least rank."""
        none = np.int32(len(self.made))
        ends = np.cumsum(size)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        rank = np.full(len(symbols), none, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self._rank(symbols[:-1] * self.width + symbols[1:])
        rank[ends - 1] = none  # a pair never crosses pieces
        bounds = np.concatenate(([0], ends))
        word = np.arange(len(size))
        done_ids, done_words, done_sizes = [], [], []
        while True:
            sizes = np.diff(bounds)
            least = np.minimum.reduceat(rank, bounds[:-1])
            over = least == none
            if over.any():
                out = np.repeat(over, sizes)
                done_ids.append(symbols[out])
                done_words.append(word[over])
                done_sizes.append(sizes[over])
                stay = ~out
                symbols, rank, word, sizes, least = symbols[stay], rank[stay], word[~over], sizes[~over], least[~over]
                if not len(word):
                    break
                bounds = np.concatenate(([0], np.cumsum(sizes)))
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            owner = np.searchsorted(hits, bounds[:-1])
            first = hits[owner]
            symbols[first] = self.made[least]
            keep = np.ones(len(symbols), np.bool_)
            keep[first + 1] = False
            symbols, rank = symbols[keep], rank[keep]
            sizes = sizes - 1
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            at = first - np.arange(len(first))
            # only the pairs before and after a merge have changed
            rank[at] = none
            if len(a := at[at + 1 < bounds[1:]]):
                rank[a] = self._rank(symbols[a] * self.width + symbols[a + 1])
            if len(b := at[at > bounds[:-1]] - 1):
                rank[b] = self._rank(symbols[b] * self.width + symbols[b + 1])
        words, sizes = np.concatenate(done_words), np.concatenate(done_sizes)
        ids = np.concatenate(done_ids)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(words)
        return ids[T.ragged(starts[order], sizes[order])], sizes[order]

    def _learned(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hard: np.ndarray, prints: np.ndarray):
        """The places in the memory of new pieces, which are remembered from now on."""
        if len(self.flat) > REMEMBERED:
            self._forget()
        size = ends - starts
        plain = np.flatnonzero(~hard & (size <= LONGEST))
        rest = np.flatnonzero(hard | (size > LONGEST))
        ids, counts, order = [], [], np.concatenate((plain, rest))
        if len(plain):
            made, sizes = self._merged(data[T.ragged(starts[plain], size[plain])], size[plain])
            ids.append(made.astype(np.uint16))
            counts.append(sizes)
        if len(rest):
            raw = [data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in rest.tolist()]
            said = [e.ids for e in self.library.encode_batch_fast(raw, add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(said), np.uint16))
            counts.append(np.fromiter(map(len, said), np.int64, len(said)))
        sizes = np.concatenate(counts)
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order)) + len(self.sizes)
        begins = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, *ids])
        self.begins = np.concatenate((self.begins, begins))
        self.sizes = np.concatenate((self.sizes, sizes))
        place = (prints >> np.uint64(64 - PLACES_BITS)).astype(np.int64)
        self.prints[place] = prints
        self.index[place] = at  # of two pieces with one place the last is kept, in both arrays
        return at

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(lowered bytes, starts, ends, hard, row bounds): runs of letters, digits, runs of others, hard chunks."""
        kind = KINDS[data]
        follows = np.zeros(len(data), np.bool_)
        follows[1:] = data[:-1] == 0xC3
        high = data >= 0x80
        if high.any():
            sign = follows & ((data == 0x97) | (data == 0xB7))  # the signs of multiplication and division
            kind[sign | (high & ~follows & (data != 0xC3))] = HARD
        lowered = T.LOWER[data]
        lowered[follows & (data >= 0x80) & (data <= 0x9E)] += 0x20
        raw = data.tobytes()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                kind[at : at + len(content)] = HARD
                at = raw.find(content, at + 1)
        starts, ends, _ = T.word_spans(data, bounds, T.NOT_SPACE)
        is_hard = kind == HARD
        if is_hard.any():
            seen = np.concatenate(([0], np.cumsum(is_hard)))
            bad = seen[ends] > seen[starts]
            where = T.ragged(starts[bad], (ends - starts)[bad])
            kind[where] = HARD
            lowered[where] = data[where]  # the library lowers these itself
        begin = np.ones(len(data), np.bool_)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begin[bounds[:-1][bounds[:-1] < len(data)]] = True
        heads = np.flatnonzero(begin)
        tails = np.append(heads[1:], len(data))
        word = kind[heads] != SPACE
        heads, tails = heads[word], tails[word]
        return lowered, heads, tails, kind[heads] == HARD, np.searchsorted(heads, bounds)

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of the rows in them) of texts that lie one after the other in `data`."""
        if not len(data):
            return np.empty(0, np.uint16), np.zeros(len(bounds), np.int64)
        lowered, starts, ends, hard, rows = self._pieces(data, bounds)
        if not len(starts):
            return np.empty(0, np.uint16), np.zeros(len(bounds), np.int64)
        prints = T.span_prints(lowered, starts, ends)
        place = (prints >> np.uint64(64 - PLACES_BITS)).astype(np.int64)
        new = np.flatnonzero(self.prints[place] != prints)
        spot = self.index[place].astype(np.int64)
        begins, sizes, flat = self.begins, self.sizes, self.flat
        if len(new):
            _, first, back = np.unique(prints[new], return_index=True, return_inverse=True)
            one = new[first]
            known = np.ones(len(prints), np.bool_)
            known[new] = False
            old_begins, old_sizes, old_flat = begins[spot[known]], sizes[spot[known]], flat
            spot[new] = self._learned(lowered, starts[one], ends[one], hard[one], prints[one])[back]
            if len(self.flat) < len(old_flat):  # the memory was emptied: these ids come from the old one
                begins = np.empty(len(prints), np.int64)
                sizes = np.empty(len(prints), np.int64)
                begins[known], sizes[known] = old_begins + len(self.flat), old_sizes
                begins[new], sizes[new] = self.begins[spot[new]], self.sizes[spot[new]]
                flat = np.concatenate((self.flat, old_flat))
            else:
                begins, sizes, flat = self.begins[spot], self.sizes[spot], self.flat
        else:
            begins, sizes = begins[spot], sizes[spot]
        total = np.concatenate(([0], np.cumsum(sizes)))
        return flat[T.ragged(begins, sizes)], total[rows]


_LOADED: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    """One tokenizer for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def encoded(texts: pa.Array, path: str, limit: int = 1 << 20):
    """(first row, end row, ids, bounds) of whole rows, about `limit` bytes at a time."""
    model = loaded(path)
    for first, end, data, bounds in T.slices(texts, limit):
        yield first, end, *model.ids(data, bounds)
