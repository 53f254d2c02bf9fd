"""Brute-force versions shared by the tests of this folder."""

import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows, percent):
    """Smallest linked doc_id by doc_id; links of shingle sets with 100 * both >= percent * all."""
    rows = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}
