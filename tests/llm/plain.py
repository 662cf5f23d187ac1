"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def lowered(text):
    return (text or "").encode().lower()


def repeats(rows, length):
    """{(doc_id, text): (n_words, n_removed, sha256)} for rows of (doc_id, text)."""
    first = {}
    for doc_id, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - length + 1):
            if doc_id is not None:
                run = tuple(w[i : i + length])
                first[run] = min(doc_id, first.get(run, doc_id))
    out = {}
    for doc_id, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - length + 1):
            if doc_id is not None and first[tuple(w[i : i + length])] < doc_id:
                gone |= set(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id, text] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, n):
    w = lowered(text).split()
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def near_groups(rows, n, percent):
    """[(doc_id, text, n_shingles, component_id, n_links)] for rows of (doc_id, text)."""
    sets = [shingles(text, n) for _, text in rows]
    holders = defaultdict(list)
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in enumerate(sets):
        common = defaultdict(int)
        for s in own:
            for j in holders[s]:
                common[j] += 1
            holders[s].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(own) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return [
        (doc_id, text, len(sets[i]), least.get(top(i)), links[i])
        for i, (doc_id, text) in enumerate(rows)
    ]
