"""Plain versions of the contracts, over Python lists."""

import hashlib
import re
import zlib

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(x) for x in digits]), 1):
        total += d if i % 2 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def named(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, kinds.index(k), k, b) for k, a, b in spans))


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(d := re.sub(r"[\x20-]", "", v)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def pii(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PII.items() for m in re.finditer(p, text or "") if ok(m[0])]


SECRETS = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def secrets(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in SECRETS.items() for m in re.finditer(p, text or "", re.A) if ok(m)]


def words(text):
    return re.findall(SPACE, text or "")


def substring(rows, window=13):
    """rows: (doc_id, text) -> (doc_id, n_words, n_removed, kept text)."""
    first = {}
    key = lambda i: float("inf") if i is None else i
    cut = [(i, words(t)) for i, t in rows]
    for i, w in cut:
        for j in range(len(w) - window + 1):
            x = tuple(w[j : j + window])
            first[x] = min(first.get(x, float("inf")), key(i))
    out = []
    for i, w in cut:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < key(i):
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y)))
    return out


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def classes(rows, width=3, percent=90):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())
