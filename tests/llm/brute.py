"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def words(text):
    return (text or "").encode().split()


def alnum(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def key(doc_id):
    return (doc_id is not None, doc_id or 0)


def substrings(rows, size=13):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - size + 1):
            own = tuple(w[k : k + size])
            first[own] = min(first.get(own, key(i)), key(i))
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < key(i):
                gone.update(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept.decode()))
    return out


def quality_counts(text):
    w = words(text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeated = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(len(x.decode()) for x in w), symbols, len(lines) - len(set(lines)), len(repeated)


def benchmark(rows, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1):
            if n:
                windows[tuple(w[k : k + n])].add(str(item) if item is not None else "")
    out = []
    for i, text in rows:
        w = alnum(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = tuple(w[k : k + n])
                if own in windows:
                    hit.update(range(k, k + n))
                    found |= windows[own]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def suffixes(rows, size=100):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - size + 1):
            place = (*key(i), k)
            own = raw[k : k + size]
            first[own] = min(first.get(own, place), place)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            if first[raw[k : k + size]] < (*key(i), k):
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, bytes(c for c, x in zip(raw, gone) if not x)))
    return out


def shingles(text, size):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)])


def near_duplicates(rows, size=4, percent=80):
    """doc_id -> (sizes of its sets, component): all pairs."""
    sets = [(i, shingles(text, size)) for i, text in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            both = len(x & y)
            if a is not None and b is not None and both and 100 * both >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return [(i, len(s), find(i) if i is not None else None) for i, s in sets]


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def bigrams(text):
    w = alnum(text)
    return set(zip(w, w[1:]))


def segments(text):
    lines = (text or "").split("\n")
    out, block = [], []
    for line in [*lines, ""]:
        if line.encode().split():
            out.append(line)
            block.append(line)
        else:
            if len(block) > 1:
                out.append("\n".join(block))
            block = []
    return out


def licences(text, templates, threshold):
    """(licence, Dice coefficient) of the lines and stretches that match, one for each place."""
    lines = (text or "").split("\n")
    full = [bool(line.encode().split()) for line in lines]
    places = [(k, k) for k in range(len(lines)) if full[k]]
    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            if all(full[a : b + 1]) and not (a and full[a - 1]) and not (b + 1 < len(lines) and full[b + 1]):
                places.append((a, b))
    found = []
    for a, b in places:
        for name, template in templates.items():
            alike = dice(bigrams("\n".join(lines[a : b + 1])), bigrams(template))
            if alike >= threshold:
                found.append((-alike, -len(bigrams(template)), b - a, name, a, b))
    out = []
    for own in sorted(found):
        if all(own[5] < other[4] or other[5] < own[4] for other in out):
            out.append(own)
    return sorted((own[3], -own[0]) for own in out)
