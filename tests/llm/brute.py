"""Plain reference implementations, one text at a time."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def lower(x: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def repeats(docs, width=20):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0], d[1] is not None, d[1])):
        w = SPACE.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if x in seen:
                gone[k : k + width] = [True] * width
            seen.add(x)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text, n=5):
    w = SPACE.findall(lower(text or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near(docs, percent=85):
    """doc_id -> (n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    owners, shared = {}, Counter()
    for i, s in sorted(sets.items()):
        for x in s:
            for j in owners.setdefault(x, []):
                shared[j, i] += 1
            owners[x].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def leaks(docs, items, width=10):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = {}
    for i, text in items:
        w = ALNUM.findall(lower(text or ""))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = {}
    for i, text in docs:
        w = ALNUM.findall(lower(text or ""))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [True] * n
                    found |= own
        out[i] = (len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit))
    return out
