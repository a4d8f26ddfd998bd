"""Plain versions of the operators' definitions, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash


def sha(b):
    return hashlib.sha256(b).hexdigest()


def repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def substring(rows, window):
    top = 1 << 62
    first = defaultdict(lambda: top)
    words = [(i, [m for m in re.findall(r"[^\x20\x09-\x0D]+", t or "")]) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first[key], top if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (top if i is None else i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out


def simhash(text, shingle=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, linked):
    root = list(range(len(nodes)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(nodes)):
        for b in range(a):
            if linked(nodes[a][1], nodes[b][1]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(nodes):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, least.get(find(k))) for k, (i, _) in enumerate(nodes)]


def contamination(rows, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    tests = []
    for name, t in items:
        w = split(t)
        if w:
            n = min(window, len(w))
            tests.append(("" if name is None else str(name), {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}))
    out = []
    for i, t in rows:
        w = split(t)
        hit, names = [False] * len(w), set()
        for name, windows in tests:
            for x in windows:
                n = len(x)
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == x:
                        hit[k : k + n] = [True] * n
                        names.add(name)
        out.append((i, len(w), sum(hit), len(names), sha(",".join(sorted(names)).encode()), any(hit)))
    return out
