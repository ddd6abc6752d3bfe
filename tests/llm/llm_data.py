"""Small tables with awkward rows, and plain versions of what the operators compute."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, row string, h long, n long, root long, of string, kept string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows (doc_id, text[, source]) as documents with further columns whose names clash with those inside operators."""
    full = [(i, t, None, s[0] if s else "a", None if t is None else len(t), "x", "y", 1, None, 3, "z", None) for i, t, *s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words_of(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"W{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(seed=1, n=40):
    """Copies, near copies, shared lines, empty, null and very long texts, repeated rows and missing identifiers."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = words_of(i % 9 + seed * 100, 60)
        for _ in range(rng.choice([0, 0, 0, 1, 2, 12])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        text = " ".join(w)
        if i % 3 == 0:
            text += "\n  A line of forty characters or more that REPEATS\t\n\nshort line"
        rows.append((i * 7 % 101 + 5, text, rng.choice(["a", "b", "c", None])))
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "One"), (905, "two words"), (906, "two  words"), (907, " ".join(words_of(77, 6000))), (908, "x" * 70000), (None, "no id"), (None, rows[0][1]), (909, "\n".join(["same line, which is longer than forty characters"] * 3)), (909, "a second row of it")]
    return rows + [rows[3]]


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard_components(rows, k, num, den):
    """(doc_id, text) to component by comparing all pairs."""
    items = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in items}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holds = defaultdict(list)
    for at, (_, s) in enumerate(items):
        for x in s:
            holds[x].append(at)
    for at, (i, s) in enumerate(items):
        for other, both in Counter(o for x in s for o in holds[x] if o < at).items():
            j, t = items[other]
            if den * both >= num * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in items}, {i: len(s) for i, s in items}


def line_result(rows, least_docs=5, least_chars=40):
    """Per row: kept text, number of lines, number of dropped lines."""
    key = lambda l: l.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least_chars:
                    held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [l for l in lines if i is None or len(held.get(key(l), ())) < least_docs or max(held[key(l)]) == i]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet").orderBy(F.monotonically_increasing_id())
