"""The operators again, by the plainest means, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = b" \t\n\x0b\x0c\r"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def quality(text: str | None) -> tuple:
    w = words(text)
    chars = sum(len(x.decode()) for x in w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    lines = [x for x in (text or "").split("\n") if words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 3000 else len(lines) - len(set(lines))
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return len(w), chars, symbols, dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def repeats(rows: list[tuple], width: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) for (doc_id, text)."""
    big = 1 << 63
    least: dict[tuple, int] = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            least[x] = min(least.get(x, big + 1), big if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < (big if i is None else i):
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def fingerprint(text: str | None, width: int = 3) -> int:
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows: list[tuple], width: int = 3) -> list[tuple]:
    """(doc_id, fingerprint, component_id) for (doc_id, text)."""
    prints = np.array([fingerprint(t, width) for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3).tolist():
            parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)].append(doc_id)
    return [(d, f"{int(prints[i]):016x}", min(ids[root(i)], default=None)) for i, (d, _) in enumerate(rows)]


def exact(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        out.append((i, max((x for x in g if x is not None), default=None), len(g), sha((t or "").encode())))
    return out


def line_runs(rows: list[tuple], t: int = 3) -> list[tuple]:
    """(doc_id, n_lines, n_removed, text) for (doc_id, text) with distinct ids."""
    first: dict[tuple, tuple] = {}
    own = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        own[i] = [(n, x.strip(" \t\x0b\x0c\r")) for n, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
    for i in sorted(own, key=lambda x: (x is None, x)):
        for s in range(len(own[i]) - t + 1):
            first.setdefault(tuple(x for _, x in own[i][s : s + t]), (i, s))
    out = []
    for i, text in rows:
        gone = set()
        for s in range(len(own[i]) - t + 1):
            f = first[tuple(x for _, x in own[i][s : s + t])]
            if f[0] != i or s - f[1] >= t:
                gone |= {n for n, _ in own[i][s : s + t]}
        lines = (text or "").split("\n")
        kept = text if not gone else "\n".join(x for n, x in enumerate(lines) if n not in gone)
        out.append((i, len(own[i]), len(gone), kept))
    return out


def targets(sizes: dict, weights=(5.0, 2.0, 1.0), limit=3) -> dict:
    """Water filling by rounds."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > limit * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = float(limit * sizes[s])
        left = sum(sizes.values()) - sum(fixed.values())
