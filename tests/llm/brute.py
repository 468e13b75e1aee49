"""Plain, slow versions of the operators to hold their results against."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(docs, k=3, percent=85):
    """doc_id -> (set size, least id of its component), from (doc_id, text) pairs with distinct ids."""
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(docs, window=13):
    """doc_id -> (words, removed, digest) from (doc_id, text) pairs."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    least = {}
    for i in sorted(words, reverse=True):
        for k in range(len(words[i]) - window + 1):
            least[tuple(words[i][k : k + window])] = i
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def contamination(docs, items, window=10):
    """doc_id -> (words, hit words, sorted items)."""
    patterns = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns[tuple(w[k : k + m])].add(str(item))
    sizes = {len(p) for p in patterns}
    out = {}
    for i, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (p := tuple(w[k : k + m])) in patterns:
                    found |= patterns[p]
                    hit[k : k + m] = [True] * m
        out[i] = (len(w), sum(hit), sorted(found))
    return out


def base_spans(text):
    """The fixed kinds of secrets, by stepping through the text."""
    text, out = text or "", []
    at = 0
    pattern = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    while m := pattern.search(text, at):
        if len(m[2]) >= 6:
            out.append((m.start(), m.end(), "assign"))
        at = m.end()
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))
