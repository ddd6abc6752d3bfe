"""Context primitives against brute force on small random frames with ties and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import context as C
from eventloom.operators.cooccurrence import co_occurrence

SCHEMA = "key string, seq bigint, us bigint, kind string, value string, amount bigint"


def make_rows(seed, n=160, keys=3, span=400, step=1):
    rng = random.Random(seed)
    return [
        (
            None if rng.random() < 0.05 else f"k{rng.randrange(keys)}",
            i,
            rng.randrange(span) * step,
            rng.choice("pnt"),
            None if rng.random() < 0.1 else f"v{rng.randrange(6)}",
            rng.randrange(50),
        )
        for i in range(n)
    ]


def trailing(rows, e, window_us):
    return [c for c in rows if e[2] - window_us <= c[2] and (c[2], c[1]) <= (e[2], e[1])]


# window and slice in seconds; us values are single digits of microseconds
CASES = [(1, 40e-6, 7e-6), (2, 40e-6, 100e-6), (3, 13e-6, 13e-6), (4, 500e-6, 3e-6), (5, 0.0, 5e-6), (6, 25e-6, None)]


@pytest.mark.parametrize("seed,window,slice_secs", CASES)
def test_count_sum_distinct(spark, seed, window, slice_secs):
    rows = make_rows(seed)
    w = C.window_micros(window)
    df = spark.createDataFrame(rows, SCHEMA)
    is_p = F.col("kind") == "p"
    counts = C.trailing_count(df, ["key"], window, member=is_p, emit=F.col("kind") != "t", slice_secs=slice_secs)
    got = {r.seq: r.n for r in counts.collect()}
    want = {
        e[1]: sum(c[0] == e[0] and c[3] == "p" for c in trailing(rows, e, w)) if e[0] else 0
        for e in rows
        if e[3] != "t"
    }
    assert got == want

    sums = C.trailing_sum(df, ["key"], window, F.col("amount"), keep=["value"], slice_secs=slice_secs)
    got = {r.seq: (r.total, r.value) for r in sums.collect()}
    want = {
        e[1]: (sum(c[5] for c in trailing(rows, e, w) if c[0] == e[0]) if e[0] else 0, e[4]) for e in rows
    }
    assert got == want

    distinct = C.trailing_distinct(df, ["key"], window, F.col("value"), member=is_p, slice_secs=slice_secs)
    got = {r.seq: r.n for r in distinct.collect()}
    want = {
        e[1]: len({c[4] for c in trailing(rows, e, w) if c[0] == e[0] and c[3] == "p" and c[4]}) if e[0] else 0
        for e in rows
    }
    assert got == want

    present = C.type_present(df, window, member=is_p, emit=F.col("kind") == "t", slice_secs=slice_secs)
    got = {r.seq: r.present for r in present.collect()}
    want = {e[1]: any(c[3] == "p" for c in trailing(rows, e, w)) for e in rows if e[3] == "t"}
    assert got == want


def test_blocks_of_slices(spark, monkeypatch):
    """A key whose slices fill many blocks, with silent blocks between: equal to brute force, no task holds all slices."""
    monkeypatch.setattr(C, "SLICES_OF_A_BLOCK", 4)
    rows = make_rows(11, n=300, keys=2, span=700)
    df = spark.createDataFrame(rows, SCHEMA)
    counts = C.trailing_count(df, ["key"], 150e-6, emit=F.col("kind") != "t", slice_secs=2e-6)
    want = {e[1]: sum(c[0] == e[0] for c in trailing(rows, e, 150)) if e[0] else 0 for e in rows if e[3] != "t"}
    assert {r.seq: r.n for r in counts.collect()} == want
    distinct = C.trailing_distinct(df, ["key"], 90e-6, F.col("value"), slice_secs=1e-6)
    want = {e[1]: len({c[4] for c in trailing(rows, e, 90) if c[0] == e[0] and c[4]}) if e[0] else 0 for e in rows}
    assert {r.seq: r.n for r in distinct.collect()} == want


def test_window_edge_is_inclusive(spark):
    rows = [("a", 0, 0, "p", "x", 1), ("a", 1, 120_000_000, "p", "x", 1), ("a", 2, 120_000_001, "p", "y", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.seq: r.n for r in C.trailing_count(df, ["key"], 120).collect()}
    assert got == {0: 1, 1: 2, 2: 2}


def test_negative_times_and_empty(spark):
    rows = [("a", 0, -5, "p", "x", 1), ("a", 1, -3, "p", "x", 1), ("a", 2, 2, "p", "y", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.seq: r.n for r in C.trailing_distinct(df, ["key"], 5e-6, F.col("value"), slice_secs=2e-6).collect()}
    assert got == {0: 1, 1: 1, 2: 2}
    assert C.trailing_count(df.limit(0), ["key"], 120).count() == 0


def best_triple(rows, t, w):
    ps = [r for r in rows if r[3] == "p"]
    ns = [r for r in rows if r[3] == "n"]

    def first_in(facts):
        inside = [f for f in facts if t[2] - w <= f[2] and (f[2], f[1]) <= (t[2], t[1])]
        return min(inside, key=lambda f: (f[2], f[1]), default=None)

    p, n = first_in(ps), first_in(ns)
    if p and n:
        return p[1], n[1]
    best = None
    for p in ps:
        for n in ns:
            span = max(p[2], n[2], t[2]) - min(p[2], n[2], t[2])
            if span <= w:
                # equal times on one side: the latest before, the earliest after
                order = (
                    span, abs(p[2] - t[2]), p[2] > t[2], abs(n[2] - t[2]), n[2] > t[2],
                    -p[1] if (p[2], p[1]) < (t[2], t[1]) else p[1],
                    -n[1] if (n[2], n[1]) < (t[2], t[1]) else n[1],
                )
                if best is None or order < best[0]:
                    best = (order, p[1], n[1])
    return best and best[1:]


@pytest.mark.parametrize("seed,window,slice_secs", [(1, 40e-6, 7e-6), (2, 90e-6, None), (3, 4e-6, 50e-6), (4, 200e-6, 1e-6)])
def test_co_occurrence(spark, seed, window, slice_secs):
    rng = random.Random(seed)
    rows = [
        ("k", i, us, rng.choices("pnt", [2, 2, 5])[0], f"v{i}", 0)
        for i, us in enumerate(rng.sample(range(3000), 150))
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    kind = F.col("kind")
    out = co_occurrence(
        df, window, trigger=kind == "t", first=kind == "p", second=kind == "n", keep=["value"], slice_secs=slice_secs
    )
    got = {r.seq: (r.first_event.seq, r.second_event.seq) for r in out.collect()}
    w = C.window_micros(window)
    want = {t[1]: best_triple(rows, t, w) for t in rows if t[3] == "t"}
    assert got == {k: v for k, v in want.items() if v}


def test_gates(spark):
    df = spark.range(1, 12).select(F.col("id").alias("n"))
    assert [r.n for r in df.where(C.every_nth(F.col("n"), 5)).collect()] == [5, 10]
    hit = df.where(C.crosses_multiple(F.col("n"), F.col("n") - 3, 4))
    assert [r.n for r in hit.collect()] == [4, 5, 6, 8, 9, 10]
