"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import re
from itertools import combinations

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))


def shingle_set(text: str | None, size: int = 5) -> set[tuple]:
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(ids, links) -> dict:
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_components(texts: dict[int, str | None], percent: int = 75, size: int = 5) -> dict[int, tuple[int, int]]:
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(texts, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}
