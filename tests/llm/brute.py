"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AFTER_ALL = 1 << 63


def order(doc_id):
    return AFTER_ALL if doc_id is None else doc_id


def repeats(rows, window, units):
    """(doc_id, units, removed, spans) per row; ``units`` turns a text into a list."""
    first = {}
    texts = [(order(d), units(t or "")) for d, t in rows]
    for d, own in texts:
        for i in range(len(own) - window + 1):
            gram = tuple(own[i : i + window])
            first[gram] = min(first.get(gram, d), d)
    out = []
    for (doc_id, _), (d, own) in zip(rows, texts):
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = tuple(u for u, g in zip(own, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(own), sum(gone), spans, kept))
    return sorted(out, key=repr)


def shingles(text, k):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near(rows, k, percent):
    """(doc_id, shingles, component) per row."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    meet = defaultdict(set)
    for i, own in enumerate(sets):
        for s in own:
            meet[s].add(i)
    for i, own in enumerate(sets):
        for j in {j for s in own for j in meet[s] if j < i}:
            shared = len(own & sets[j])
            if 100 * shared >= percent * (len(own) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        known = [d for d in least[find(i)] if d is not None]
        out.append((doc_id, len(sets[i]), min(known) if known else None))
    return sorted(out, key=repr)
