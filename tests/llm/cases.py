"""Small tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that operators use inside; an input may have them too.
CLASH = "id n s g cls size kept keep_id group_size score predicted lang_pred held_out target taken start block tokens n_tokens n_bytes key node vec weight payload host path html_ text_".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)

BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix odd potions in a dark old cellar and nobody ever asks them why at all today".split()
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
TEXTS = [
    (1, " ".join(BASE), "en", "a"),
    (2, " ".join(BASE), "en", "b"),
    (3, " ".join(BASE[:-1] + ["Tomorrow"]), "en", "a"),
    (4, None, None, None),
    (5, "", "en", None),
    (6, " \t\n ", None, "c"),
    (7, "one two", "en", "c"),
    (8, "ONE two", "fr", "c"),
    (9, LONG, "de", "a"),
    (10, LONG + " end", "de", "z"),
    (11, "!!! 123 ...", "es", "b"),
    (12, "The Quick\tbrown\nfox " + " ".join(BASE[4:]), "en", "\U0001f600"),
    (13, "é è ñ ß 漢字 \U0001f600 mixed", "fr", "é"),
    (14, "x" * 70_000, "en", "a"),
    (None, "no id here", "en", "a"),
    (15, "twice", "en", "b"),
    (15, "twice", "en", "b"),
]


def documents(spark, rows=TEXTS):
    data = [(i, t, la, s, None if t is None else len(t), *["?"] * len(CLASH)) for i, t, la, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def jaccard_components(rows):
    """{id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            held[g].add(i)
    pairs = {(a, b) for ids in held.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}
