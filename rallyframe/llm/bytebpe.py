"""A byte-level BPE tokenizer over whole batches: each distinct piece is merged once, all pieces together.

The file is one of the `tokenizers` library with byte-level pieces. Texts are cut here the way its splitting pattern
cuts them, many at a time; a worker remembers the ids of a piece. Stretches with other scripts go to the library, and
texts with white space beyond ASCII, odd control characters or the text of an added token whole: its ids are its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from rallyframe.llm import textbytes as T
from rallyframe.llm.wordbpe import WordBPE, byte_letters

#: The splitting pattern that _pieces follows; fixed by the library for byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK, SPACE, LETTER, DIGIT, OTHER, HARD = range(6)
#: Bytes of one text that are cut at a time, if it has blanks to cut at.
PART_BYTES = 1 << 20


def _byte_classes() -> np.ndarray:
    """Blank, other white space, letters, digits, other ASCII; 0xC3 and its followers are letters; the rest is hard."""
    kind = np.full(256, HARD, np.uint8)
    kind[:0x80] = OTHER
    kind[0x09:0x0E] = SPACE
    kind[0x20] = BLANK
    kind[0x30:0x3A] = DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = LETTER
    kind[0x80:0xC0] = kind[0xC3] = LETTER
    return kind


KINDS = _byte_classes()
#: Bytes after an apostrophe that make a contraction with it; fixed by the pattern.
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")


def _odd(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII, or a control character that may count as such, begins."""
    if not len(data):
        return np.empty(0, np.int64)
    one = np.zeros(len(data) + 2, np.uint8)
    one[: len(data)] = data
    a, b, c = one[:-2], one[1:-1], one[2:]
    found = (a >= 0x1C) & (a <= 0x1F)
    if (a >= 0x80).any():
        found |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        found |= (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
        found |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8F) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81) & (c >= 0x9F))
        found |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        found |= (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
    return np.flatnonzero(found)


class ByteBPE(WordBPE):
    """ids(data, bounds): the token ids of texts that lie one after the other, and where each text's begin."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        splits = said["pre_tokenizer"]
        if said["normalizer"] or splits["type"] != "ByteLevel" or splits["add_prefix_space"] or not splits["use_regex"]:
            raise ValueError(f"{path}: not a byte-level BPE that takes texts as they are")
        vocab = said["model"]["vocab"]
        if max(vocab.values()) >= 1 << 16:
            raise ValueError(f"{path}: ids beyond 16 bits")
        self.inner = self.final = np.array([vocab[x] for x in byte_letters()], np.int64)
        self._merges(vocab, said["model"]["merges"])
        self.library = Tokenizer.from_file(path)
        self.added = [token["content"].encode() for token in said["added_tokens"]]
        self._forget()

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bytes, starts, ends, hard, row bounds): the pieces of the pattern; stretches with other scripts whole."""
        kind = KINDS[data]
        follows = np.zeros(len(data), np.bool_)
        follows[1:] = data[:-1] == 0xC3
        if (data >= 0x80).any():
            high = data >= 0x80
            sign = follows & ((data == 0x97) | (data == 0xB7))  # the signs of multiplication and division
            kind[sign | (high & ~follows & (data != 0xC3))] = HARD
        white = kind <= SPACE
        starts, ends, _ = T.word_spans(data, bounds, T.NOT_SPACE)
        hard = kind == HARD
        if hard.any():
            seen = np.concatenate(([0], np.cumsum(hard)))
            bad = seen[ends] > seen[starts]
            kind[T.ragged(starts[bad], (ends - starts)[bad])] = HARD
        text_start = np.zeros(len(data), np.bool_)
        text_start[bounds[:-1][bounds[:-1] < len(data)]] = True
        before = np.full(len(data), SPACE, np.uint8)
        before[1:] = kind[:-1]
        before[text_start] = SPACE
        begin = text_start | (kind != before)
        white_before = before <= SPACE
        begin[white & white_before & ~text_start] = False  # a run of white space is one piece but for its last one
        text_end = np.zeros(len(data) + 1, np.bool_)
        text_end[bounds] = True
        after = np.zeros(len(data), np.bool_)
        after[:-1] = ~white[1:]
        last = white & after & ~text_end[1:]  # the last white space before a word is cut off
        begin |= last
        joins = np.flatnonzero(last & (kind == BLANK)) + 1  # and a blank goes with the word
        begin[joins] = False
        self._contractions(data, kind, before, begin, text_start)
        heads = np.flatnonzero(begin)
        tails = np.append(heads[1:], len(data))
        return data, heads, tails, kind[tails - 1] == HARD, np.searchsorted(heads, bounds)

    @staticmethod
    def _contractions(
        data: np.ndarray, kind: np.ndarray, before: np.ndarray, begin: np.ndarray, text_start: np.ndarray
    ) -> None:
        """An apostrophe that begins a piece takes the letters of a contraction; what follows them is a new piece."""
        at = np.flatnonzero((data == 0x27) & (kind == OTHER) & begin & (before != BLANK))
        at = at[~np.append(text_start, True)[at + 1]]
        if not len(at):
            return
        padded = np.zeros(len(data) + 4, np.uint8)
        padded[: len(data)] = data
        edge = np.ones(len(data) + 4, np.bool_)
        edge[: len(data)] = begin
        one, two = padded[at + 1], padded[at + 2]
        letters = np.append(kind, np.full(4, SPACE, np.uint8))
        short = np.isin(one, np.frombuffer(SHORT, np.uint8)) & (letters[at + 1] == LETTER)
        long = np.zeros(len(at), np.bool_)
        for pair in LONG:
            long |= (one == pair[0]) & (two == pair[1])
        long &= (letters[at + 1] == LETTER) & ~edge[at + 2] & ~short
        for found, size in ((at[short], 2), (at[long], 3)):
            begin[found + 1] = False
            ends = found + size
            inside = ends < len(data)
            begin[ends[inside]] = True

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of the rows in them); rows that the pieces cannot be trusted with go to the library whole."""
        strange = np.zeros(len(bounds) - 1, np.bool_)
        strange[np.searchsorted(bounds, _odd(data), side="right") - 1] = True
        raw = data.tobytes()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                strange[np.searchsorted(bounds, at, side="right") - 1] = True
                at = raw.find(content, at + 1)
        if not strange.any():
            return super().ids(data, bounds)
        sizes = np.diff(bounds)
        plain = T.ragged(bounds[:-1][~strange], sizes[~strange])
        own, own_bounds = super().ids(data[plain], np.concatenate(([0], np.cumsum(sizes[~strange]))))
        rows = np.flatnonzero(strange).tolist()
        texts = [raw[bounds[k] : bounds[k + 1]].decode("utf-8", "replace") for k in rows]
        said = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.empty(len(sizes), np.int64)
        counts[~strange] = np.diff(own_bounds)
        counts[strange] = [len(x) for x in said]
        total = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(total[-1], np.uint16)
        out[T.ragged(total[:-1][~strange], counts[~strange])] = own
        out[T.ragged(total[:-1][strange], counts[strange])] = np.fromiter(chain.from_iterable(said), np.uint16)
        return out, total


def _parts(data: np.ndarray, strange: bool) -> Iterator[np.ndarray]:
    """A long text in parts, cut before blanks that follow a word: there the pattern always cuts."""
    at = 0
    while len(data) - at > PART_BYTES and not strange:
        near = data[at + PART_BYTES // 2 : at + PART_BYTES]
        cuts = np.flatnonzero((near[1:] == 0x20) & T.NOT_SPACE[near[:-1]])
        if not len(cuts):
            break
        end = at + PART_BYTES // 2 + int(cuts[-1]) + 1
        yield data[at:end]
        at = end
    yield data[at:]


_LOADED: dict[str, ByteBPE] = {}


def encoded_bytes(texts: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, bounds) of whole rows, about a MB of text at a time; a longer text is cut within."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    model = _LOADED[path]
    for first, end, data, bounds in T.slices(texts):
        if end - first > 1 or len(data) <= PART_BYTES:
            yield first, end, *model.ids(data, bounds)
            continue
        raw = data.tobytes()
        strange = len(_odd(data)) > 0 or any(content in raw for content in model.added)
        found = [model.ids(part, np.array([0, len(part)]))[0] for part in _parts(data, strange)]
        ids = np.concatenate(found)
        yield first, end, ids, np.array([0, len(ids)])
