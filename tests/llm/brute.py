"""Operators written out in plain Python for small inputs."""

from __future__ import annotations

import re

_LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(rows, size, percent):
    """{id: (set size, least id reachable)}"""
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def deleted_lines(rows, least):
    """{row: deleted line numbers} of (id, text) in corpus order, by looking at every run."""
    docs = [((t or "").split("\n")) for _, t in rows]
    size = [[max(1, len(x.strip(" ").split())) for x in d] for d in docs]
    seen, out = {}, {k: set() for k in range(len(docs))}
    for k, d in enumerate(docs):
        for a in range(len(d)):
            for b in range(a + 1, len(d) + 1):
                seen.setdefault(tuple(d[a:b]), (k, a))
    for k, d in enumerate(docs):
        for a in range(len(d)):
            for b in range(a + 1, len(d) + 1):
                if sum(size[k][a:b]) >= least and seen[tuple(d[a:b])] < (k, a):
                    out[k].update(range(a, b))
    return out


def windows_hit(docs, items, size):
    """[(words, hit positions, item ids)] for each text."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_LOW))
    wanted = [(str(i), tuple(w[k : k + size])) for i, t in items for w in [split(t)] for k in range(max(1, len(w) - size + 1) if w else 0)]
    out = []
    for t in docs:
        w, hit, found = split(t), set(), set()
        for i, x in wanted:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found.add(i)
        out.append((w, sorted(hit), sorted(found)))
    return out
