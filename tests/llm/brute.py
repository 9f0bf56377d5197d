"""Plain readings of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def removals(docs, window=13):
    """doc_id -> (n_words, n_removed, kept_sha256) for unique ids."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for a in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][a : a + window]), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for a in range(len(ws) - window + 1):
            if first[tuple(ws[a : a + window])] < i:
                gone.update(range(a, a + window))
        out[i] = (len(ws), len(gone), sha(" ".join(w for n, w in enumerate(ws) if n not in gone)))
    return out


def lower_az(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, k=4):
    ws = WORD.findall(lower_az(text or ""))
    if not ws:
        return set()
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))}


def components(docs, k=4, percent=85):
    """doc_id -> (n_shingles, component_id) for unique ids."""
    sets = {i: shingles(t, k) for i, t in docs}
    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in sets:
        both = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                if j < i:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def base_spans(text):
    found = []
    for n, (_, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), n, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


def base_row(text):
    spans = base_spans(text)
    counts = tuple(sum(k == n for _, k, _ in spans) for n in range(3))
    return *counts, sha(",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in spans))


def hard_negatives(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """Rows of the contract from ``(vec_id, label, whole numbers)``; repeated rows count as often as they stand."""
    out = []
    anchors = {}
    for i, label, vector in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, vector)), (label, vector))
    for a, (label, vector) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), i, other) for i, other, v in rows if i != a)
        near = [(i, -s) for s, i, other in scored if other == label][:positives]
        for p, ps in near:
            far = [(i, -s) for s, i, other in scored if other != label and low * ps <= -100 * s <= high * ps]
            out += [(a, p, r, n, ps, ns) for r, (n, ns) in enumerate(far[:negatives], 1)]
    return sorted(out)


def shared_lines(docs, min_docs=3, least=20):
    """(doc_id, n_lines, n_dropped, kept text) a row; rows of one id are one document, all without an id another before them."""
    holders = defaultdict(set)
    key = lambda line: lower_az(line.strip(" \t\n\v\f\r"))
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(float("-inf") if i is None else i)
    out = []
    for i, text in docs:
        lines, own = (text or "").split("\n"), float("-inf") if i is None else i
        gone = [len(k) >= least and len(holders[k]) >= min_docs and max(holders[k]) != own for k in map(key, lines)]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def periodic(words, times=4, least=6):
    """(start, length, period) of every maximal run, by start and period."""
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    smaller = lambda s, l, q: any(b < q and a <= s and a + c >= s + l for a, c, b in found)
    return sorted((r for r in found if not smaller(*r)), key=lambda r: (r[0], r[2]))
