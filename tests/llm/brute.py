"""Plain, slow versions of the operators, written from their contracts."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def substring(rows, window):
    first = {}
    split = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def suffixes(rows, window):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        for k in range(len(raw) - window + 1):
            first.setdefault(raw[k : k + window], (i, k))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if first[raw[k : k + window]] < (i, k):
                gone[k : k + window] = b"\1" * window
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def shingles(text, size=5):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def link_components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(k)
    overlap = defaultdict(int)
    for ks in holders.values():
        for x in range(len(ks)):
            for y in range(x):
                overlap[ks[y], ks[x]] += 1
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, b), n in overlap.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            parent[root(a)] = root(b)
    low = defaultdict(lambda: 1 << 62)
    for k, (i, _) in enumerate(sets):
        low[root(k)] = min(low[root(k)], i)
    return sorted((i, len(s), low[root(k)]) for k, (i, s) in enumerate(sets))
