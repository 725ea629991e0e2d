"""Small tables with what operators have to bear, and brute-force forms."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(texts, threshold=80):
    """doc_id -> smallest doc_id reachable by links."""
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    for i, s in sets.items():
        c = Counter(j for g in s for j in index[g] if j < i)
        for j, n in c.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                if a != b:
                    up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def held_out(doc_id, m, r):
    return zlib.crc32(str(doc_id).encode()) % m == r


def doc_rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, ties and odd white space."""
    base = " ".join(f"word{i % 37}x{i}" for i in range(120))
    near = base.replace("word5x5 ", "other ")
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, near, "en", "b", 1),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n ", "en", None, 4),
        (7, long, "de", "c", 1),
        (8, long + " end", "de", "c", 1),
        (9, "One two", "en", "c", 7),
        (10, "one  TWO", "en", "d", 8),
        (11, "x\n\ny\nz\na", "en", "d", 8),
        (12, "Ünï cödé 漢字   text 😀 here", "en", "d", 8),
        (None, "a row without an id", "en", "a", 1),
        (13, base.replace("\x20", "\x0b"), "en", "a", 1),
        (14, "q " * 50, "en", "a", 1),
    ]
    return rows + [rows[0]]
