import glob
import hashlib
import os
import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from llm_data import awkward, collected, docs, jaccard_components, line_result, words_of
from pyspark.sql import functions as F

from eventloom.llm import exact_dedup, line_dedup, ngram_join, substring_dedup
from eventloom.llm.common import _OTHER, components, released, shingle_hashes, stored, word_hashes
from eventloom.session import checkpoint_dir


def test_line_dedup_equals_brute_force(spark):
    rows = [(i, t) for i, t, *_ in awkward()] + [(950 + i, "B\n" + "long line shared by five or more documents " * 2) for i in range(5)]
    out = line_dedup.drop_repeated_lines(docs(spark, rows))
    assert collected(out, "doc_id", "kept_text", "n_lines", "n_dropped") == sorted(line_result(rows), key=repr)
    kept = line_dedup.without_repeated_lines(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept.collect()) and kept.count() == len(rows)


def test_line_runs_keep_levels_and_hold_every_line_once(spark):
    runs = line_dedup.LineRuns(spark, fan_in=2, buckets=2)
    for batch in range(5):
        data = [(bytes([k]), batch * 10 + d) for k in range(batch, batch + 3) for d in range(2)]
        runs.add(spark.createDataFrame(data + data[:1], "key binary, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    whole = {bytes(r.key): (r.n_docs, r.last_doc) for r in runs.whole().collect()}
    assert len(whole) == 7 and whole[bytes([2])] == (6, 21) and whole[bytes([6])] == (2, 41)
    held = [bytes(r.key) for level in runs.levels for name in level for r in spark.table(name).collect()]
    assert sorted(held) == sorted(whole)  # the anti-join leaves a line in the run that brought it first
    again = {}
    for level in runs.updates:
        for name in level:
            for r in spark.table(name).collect():
                again[bytes(r.key)] = again.get(bytes(r.key), 0) + r.n_docs
    assert again == {k: n - 2 for k, (n, _) in whole.items() if n > 2}
    names = [name for level in runs.levels + runs.updates for name in level]
    runs.close()
    assert not any(spark.catalog.tableExists(name) for name in names)


def test_merging_runs_and_updates_does_not_shuffle(spark):
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = line_dedup.LineRuns(spark, fan_in=9, buckets=3)
        for batch in range(2):
            runs.add(spark.createDataFrame([(bytes([k]), batch) for k in range(batch, batch + 30)], "key binary, doc_id long"))
        plan = runs.whole()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert "Exchange" not in plan


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_with_hot_and_awkward_rows(spark, keep):
    rows = [(i, t) for i, t, *_ in awkward()] + [(2000 + i, "hot text") for i in range(300)]
    out = exact_dedup.exact_duplicates(docs(spark, rows), keep=keep).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(out) == len(rows)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    stays = {}
    for r in out:
        ids = by_text[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == ((max if keep == "max" else min)(known) if known else None)
        stays.setdefault(r.text_sha256, []).extend([r.doc_id] if r.kept else [])
    assert all(len(ids) == 1 for ids in stays.values())
    assert all(not by_text[t] or stays[t][0] in (by_text[t]) for t in by_text)


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert ngram_join.similar_components(none).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 8, 10)])
def test_jaccard_components_equal_brute_force(spark, k, num, den):
    rows = {i: t for i, t, *_ in awkward() if i is not None and i != 909}
    base = words_of(5, 120)
    for i in range(60):  # near copies in a chain, some over and some under the limit
        w = list(base)
        for j in range(i % 7):
            w[(i * 13 + j * 29) % 120] = f"edit{i}"
        rows[3000 + i] = " ".join(w)
    want, sizes = jaccard_components(rows.items(), k, num, den)
    out = ngram_join.similar_components(docs(spark, [*rows.items(), (None, "no id")]), k, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got.pop(None)[1] is None
    assert got == {i: (sizes[i], want[i]) for i in rows}
    kept = ngram_join.one_of_each(docs(spark, list(rows.items())), k=k, num=num, den=den)
    assert {r.doc_id for r in kept.collect()} == {i for i in rows if want[i] == i}


def test_stored_tables_leave_no_shuffle_files_and_can_be_emptied(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shuffles = lambda: {f for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = shuffles()
    table = stored(spark.range(1000).repartition(3, "id").withColumn("part", F.col("id") % 2), "made", "part")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    assert table.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    folder = table.inputFiles()[0].split("/part=")[0].removeprefix("file://")
    released(table)
    assert spark.read.parquet(folder).count() == 0


def test_ngram_join_leaves_little_in_the_shared_folder(spark):
    shared = checkpoint_dir(spark).removeprefix("file:")
    size = lambda: {f: os.path.getsize(f) for f in glob.glob(f"{shared}/**/*.parquet", recursive=True)}
    base = words_of(6, 3000, 10**6)
    rows = [(i, " ".join([f"edit{i}" if j % 500 == i else w for j, w in enumerate(base)])) for i in range(40)]
    before = size()
    out = ngram_join.similar_components(docs(spark, rows), 5, 8, 10)
    assert sum(n for f, n in size().items() if f not in before) < 150_000  # the sets alone are 40 * 3,000 * 8 bytes
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: 0 for i in range(40)}


def test_passages_leave_no_matches_in_the_shared_folder(spark):
    shared = checkpoint_dir(spark).removeprefix("file:")
    held = lambda: set(glob.glob(f"{shared}/**/*.parquet", recursive=True))
    before = held()
    rows = [(i, " ".join([f"own{i}x{j}" for j in range(20)] + [f"p{j}" for j in range(70)])) for i in range(5)]
    found = substring_dedup.repeated_passages(docs(spark, rows))
    left = {name for name in ("matches", "seeds", "around", "pairs", "chains", "stretches", "words") for f in held() - before
            if f"/{name}-" in f and spark.read.parquet(os.path.dirname(f)).count()}
    assert not left and {d for r in found.collect() for d in (r.doc_id, r.other_id)} == set(range(5))


def test_links_run_through_rows_without_identifier(spark):
    base = words_of(8, 150)
    steps = [" ".join([f"step{j}" if j < 9 * i else w for j, w in enumerate(base)]) for i in range(4)]
    for ids in ([1, 2, 3, 4], [1, None, 3, 4], [1, None, None, 4], [None, 2, None, 1]):
        rows = list(zip(ids, steps)) + [(None, ""), (None, steps[1]), (9, "quite another text")]
        out = {r.doc_id: r.component_id for r in ngram_join.similar_components(docs(spark, rows), 3, 85, 100).collect() if r.doc_id is not None}
        assert out == {i: 1 for i in ids if i is not None} | {9: 9}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (7, 7)], "x long, y long")
    assert {r.node: r.root for r in components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 90, 90: 90}


def test_word_hashes_part_at_white_space_and_keep_order():
    words, places, first, last, joined = word_hashes(["Ab  cd\x0bAB", None, "", "é cd", "y" * 3_000_000 + " z"])
    assert [int(b - a) for a, b in zip(places[:-1], places[1:])] == [3, 0, 0, 2, 2]
    assert words[0] == words[2] and words[1] == words[4] and len(set(words.tolist())) == 5
    assert joined[first[1] : last[1]] == b"cd"
    assert len(shingle_hashes(words[:3], 5)) == 1 and len(shingle_hashes(words[:0], 5)) == 0


def test_passages_are_found_with_edits_gaps_and_copies(spark):
    own = lambda s: [f"own{s}x{i}" for i in range(70)]
    passage = [f"p{i}" for i in range(80)]
    edited = [w if i % 17 else f"e{i}" for i, w in enumerate(passage)]
    shifted = passage[:40] + ["more", "words"] + passage[40:]
    rows = [
        (1, " ".join(own(1) + passage + own(2))), (2, " ".join(passage + own(3))), (3, " ".join(own(4) + edited)), (4, " ".join(own(5) + shifted)),
        (5, " ".join(own(6))), (6, " ".join(own(7) + passage[:30])), (7, None), (8, ""), (None, " ".join(passage)), (9, " ".join(["same"] * 90)), (10, " ".join(["same"] * 70)),
    ]
    found = substring_dedup.repeated_passages(docs(spark, rows))
    got = {(r.doc_id, r.other_id): r for r in found.collect()}
    assert {d for p in got for d in p} == {1, 2, 3, 4, 9, 10}
    assert (got[2, 1].start_word, got[2, 1].end_word, got[2, 1].other_start, got[2, 1].equal_words) == (0, 80, 70, 80)
    assert got[3, 1].end_word - got[3, 1].start_word >= 75 and got[4, 1].end_word - got[4, 1].start_word == 82
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeated_passages(docs(spark, rows), found).collect() if r.doc_id}
    assert cut[1] == rows[0][1] and cut[2].split() == own(3) and cut[7] is None and cut[5] == rows[4][1]


def test_chain_takes_the_best_rising_matches():
    line = [(i * 5, 100 + i * 5) for i in range(10)]
    noise = [(i * 5, 400 - i * 7) for i in range(10)]
    best = substring_dedup.chains(line + noise)[0]
    assert best == line
    words = word_hashes(["a b c d e f g h i j k l m n"], _OTHER)[0]
    seeds = substring_dedup.seed_places(substring_dedup.kmer_hashes(words))
    assert len(seeds) and np.all(np.diff(seeds) > 0)


@pytest.mark.parametrize("changed", [4, 5])
def test_fuzzy_passages_of_fifty_words_are_all_found(spark, changed):
    rng, rows = random.Random(changed), []
    for i in range(60):
        passage = [f"p{i}x{j}" for j in range(50)]
        edited = list(passage)
        for j in rng.sample(range(1, 49), changed):
            edited[j] = f"e{i}x{j}"
        rows += [(2 * i, " ".join([f"a{i}x{j}" for j in range(9)] + passage)), (2 * i + 1, " ".join(edited + [f"b{i}x{j}" for j in range(9)]))]
    found = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.equal_words) for r in found} == {(d, 9 - 9 * (d % 2), 59 - 9 * (d % 2), 50 - changed) for d in range(120)}


def test_passages_of_lines_that_others_hold_singly(spark):
    line = lambda s: [f"{s}{j}" for j in range(30)]
    own = lambda d: [f"own{d}x{j}" for j in range(20)]
    held = {1: ["k"], 9: ["k"], 2: ["l"], 8: ["l"], 4: ["k", "l"], 6: ["k", "l"]}
    rows = [(d, " ".join(own(d) + [w for s in lines for w in line(s)] + own(d + 50))) for d, lines in held.items()]
    found = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {(r.doc_id, r.other_id, r.start_word, r.end_word, r.equal_words) for r in found} == {(4, 6, 20, 80, 60), (6, 4, 20, 80, 60)}


@pytest.mark.parametrize("holders", [1, 30])
def test_fuzzy_passages_whose_seeds_others_lead_are_found(spark, holders):
    """Every seed of the passage that 500 and 501 share is held first and last by documents that hold nothing else of it."""
    own = lambda d, n=60: [f"own{d}x{j}" for j in range(n)]
    passage = [w for i in range(6) for w in [f"r{i}w{j}" for j in range(9)] + [f"gap{i}"]]
    edited = [w.replace("gap", "other") for w in passage]
    rows = [(500, " ".join(own(500) + passage + own(9500))), (501, " ".join(own(501) + edited + own(9501)))]
    singles = [(side * 1000 + h * 10 + i, i) for side in (0, 1) for h in range(holders) for i in range(6)]
    rows += [(d, " ".join(own(d) + [f"r{i}w{j}" for j in range(9)] + own(d + 20000))) for d, i in singles]
    found = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {(r.doc_id, r.other_id, r.start_word, r.end_word, r.equal_words) for r in found} == {(500, 501, 60, 119, 54), (501, 500, 60, 119, 54)}


@pytest.mark.parametrize("holders", [1, 30])
def test_passages_of_one_component_whose_seeds_others_lead_are_found(spark, holders):
    """As before, but 500 and 501 share another passage too, which makes them one component and tells nothing of this one; nor
    do short texts that hold a seed first."""
    own = lambda d, n=60: [f"own{d}x{j}" for j in range(n)]
    passage = [w for i in range(6) for w in [f"r{i}w{j}" for j in range(9)] + [f"gap{i}"]]
    edited = [w.replace("gap", "other") for w in passage]
    whole = [f"q{j}" for j in range(60)]
    rows = [(500, " ".join(own(500) + passage + own(9500) + whole)), (501, " ".join(own(501) + edited + own(9501) + whole))]
    singles = [(side * 1000 + h * 10 + i, i) for side in (0, 1) for h in range(holders) for i in range(6)]
    rows += [(d, " ".join(own(d, 20) + [f"r{i}w{j}" for j in range(9)])) for d, i in singles]
    found = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    got = {(r.doc_id, r.other_id, r.start_word, r.end_word, r.equal_words) for r in found}
    assert got == {(a, b, *p) for a, b in ((500, 501), (501, 500)) for p in ((60, 119, 54), (180, 240, 60))}


def test_passages_that_leaders_tell_open_no_pairs(spark, monkeypatch):
    """Sixty documents hold one passage: each is told by the first and the last, so that no two others are compared again."""
    own = lambda d, n=60: [f"own{d}x{j}" for j in range(n)]
    rows = [(d, " ".join(own(d) + [f"p{j}" for j in range(70)] + own(d + 1000))) for d in range(60)]
    made = {}
    counting = substring_dedup.stored_counting
    monkeypatch.setattr(substring_dedup, "stored_counting", lambda df, name, *more: made.setdefault(name, counting(df, name, *more)))
    found = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {d for r in found for d in (r.doc_id, r.other_id)} == set(range(60)) and made["pairs"][1] == 0


def test_passage_around_one_common_line_is_found(spark):
    """One seed that very many hold, and beyond it equal words that are no seed: on one diagonal, or a second common line on another."""
    own = lambda d, n=60: [f"own{d}x{j}" for j in range(n)]
    line, second = [f"line{j}" for j in range(8)], [f"second{j}" for j in range(20)]
    tail = lambda s: [f"{s}{j}" if j % 7 == 0 else f"t{j}" for j in range(50)]
    rows = [(700, " ".join(own(700) + line + tail("a") + own(9700))), (701, " ".join(own(701) + line + tail("b") + own(9701)))]
    long_line = [f"long{j}" for j in range(19)]
    rows += [(720, " ".join(own(720) + long_line + ["x"] + second + own(9720) + ["z"])), (721, " ".join(own(721) + long_line + ["y", "z"] + second + own(9721)))]
    rows += [(d, " ".join(own(d) + long_line + own(d + 30000) + line + own(d + 20000) + second + own(d + 40000))) for d in (*range(100, 140), *range(1000, 1040))]
    rows += [(740, " ".join(own(740) + line + tail("c") + own(9740))), (50, " ".join(own(50) + line + own(9050)))]
    found = substring_dedup.repeated_passages(docs(spark, rows), least=40).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert pairs == {(a, b) for group in ((700, 701, 740), (720, 721)) for a in group for b in group if a != b}


def test_open_pairs_of_repeated_lines_leave_few_chains(spark, monkeypatch):
    """Forty documents repeat one line of 25 words: every two are open, and every repeat meets the other's first on a diagonal of its own."""
    own = lambda d, i: [f"own{d}x{i}x{j}" for j in range(300 + (7 * d + 31 * i) % 41)]
    line = [f"l{j}" for j in range(25)]
    rows = [(d, " ".join(w for i in range(6) for w in own(d, i) + line)) for d in range(40)]
    edited = [w if j % 6 else f"e{j}" for j, w in enumerate(f"p{j}" for j in range(60))]
    rows += [(50, " ".join(own(50, 0) + line + [f"p{j}" for j in range(60)])), (51, " ".join(own(51, 0) + line + edited)), (60, " ".join(own(60, 0) + line + own(60, 1)))]
    stored, chains = substring_dedup.stored, []

    def counted(df, name, *partition_by):
        out = stored(df, name, *partition_by)
        chains.extend([out.count()] if name == "chains" else [])
        return out

    monkeypatch.setattr(substring_dedup, "stored", counted)
    found = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(50, 51), (51, 50)}
    assert chains[1] < 2 * 43 * 42 / 2


def test_seeds_leave_in_turns_and_pack_well():
    rng = np.random.default_rng(8)
    hashes, docs, at = rng.integers(0, 1 << 63, 200_000).astype(np.uint64), np.repeat(np.arange(400), 500), np.tile(np.arange(500) * 2 + 1, 400)
    turns = [substring_dedup.packed(hashes, docs, at, turn, substring_dedup.TURNS) for turn in range(substring_dedup.TURNS)]
    assert max(sum(len(zlib.compress(r, 1)) for r in t["rows"]) for t in turns) < 12 * len(hashes) / substring_dedup.TURNS * 1.1
    rows = np.concatenate([substring_dedup.from_planes(t["rows"], substring_dedup._SEED) for t in turns])
    assert sorted(rows.tolist()) == sorted(zip(hashes.tolist(), docs.tolist(), at.tolist()))
    assert not {*turns[0]["part"]} & {*turns[1]["part"]}


def test_surroundings_in_turns_are_those_of_one():
    rng = np.random.default_rng(9)
    words = substring_dedup.mixed(rng.integers(0, 30, 700).astype(np.uint64))
    told, places = substring_dedup._Told(700, np.array([(5 << 32) + (90 << 1) + 1, (60 << 32) + (400 << 1)])), np.flatnonzero(rng.random(693) < 0.3)
    whole = sorted(zip(*(c.tolist() for c in substring_dedup.around(words, places, told))))
    parts = [zip(*(c.tolist() for c in substring_dedup.around(words, places, told, turn, 3))) for turn in range(3)]
    assert sorted(row for p in parts for row in p) == whole
    assert told.of(np.array([5, 4, 60, 80, 390]), np.array([90, 90, 90, 400, 401])).tolist() == [3, 0, 3, 1, 0]


def test_common_subsequences_equal_brute_force():
    rng = np.random.default_rng(10)
    for _ in range(300):
        a, b = (rng.integers(0, 5, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        row = np.zeros(len(b) + 1, dtype=np.int64)
        for w in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == w)))
        assert substring_dedup._gap_equal(a, b) == (int((a == b).sum()) if len(a) == len(b) else int(row[-1]))


def test_no_chain_with_a_passage_is_left_out_by_two_bytes_of_its_words():
    rng, rows = np.random.default_rng(3), []
    for _ in range(1500):
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in rng.integers(60, 260, 2))
        n = min(int(rng.integers(8, 90)), len(a) - 8, len(b) - 8)
        x, y = int(rng.integers(0, len(a) - n)), int(rng.integers(0, len(b) - n))
        b[y : y + n] = np.where(rng.random(n) < rng.random() * 0.25, b[y : y + n], a[x : x + n])
        if rng.random() < 0.3:
            b = np.insert(b, y + n // 2, rng.integers(0, 1 << 63, 3).astype(np.uint64))
        of = {h: i for i, h in enumerate(substring_dedup.kmer_hashes(a).tolist())}
        m = np.sort(np.array([(of[h] << 32) + j for j, h in enumerate(substring_dedup.kmer_hashes(b).tolist()) if h in of], dtype=np.int64))
        rows += [(a, b, c) for c in (substring_dedup.chains_of(m) if len(m) else [])]
    narrow = [pd.Series([(r[i] >> np.uint64(48)).astype(np.uint16).tobytes() for r in rows]) for i in (0, 1)]
    keep = substring_dedup.enough_equal(*narrow, pd.Series([np.array(c).astype(np.uint32).tobytes() for _, _, c in rows]), 50, 0.8)
    holds = np.array([bool([*substring_dedup.passages(*r, 50, 0.8)] or [*substring_dedup.stretched(*r, 50, 0.8)]) for r in rows])
    assert holds.sum() > 300 and not (holds & ~keep).any() and keep.mean() < 0.7


def test_pairs_without_passing_diagonals_keep_chains_that_turn():
    """What _turning leaves out has chains on one diagonal only."""
    rng = np.random.default_rng(12)
    for _ in range(400):
        runs = [(x + np.arange(n) << 32) + y + np.arange(n) for x, y, n in zip(rng.integers(0, 400, 4), rng.integers(0, 400, 4), rng.integers(1, 20, 4))]
        m = np.unique(np.concatenate(runs[: rng.integers(1, 5)]))
        turns = any(len({y - x for x, y in c}) > 1 for c in substring_dedup.chains_of(m))
        assert substring_dedup._turning(np.zeros(len(m), dtype=np.int64), m, 1)[0] or not turns


def test_narrow_words_never_count_fewer_equal_ones():
    rng = np.random.default_rng(5)
    for _ in range(30):
        texts = [rng.integers(0, 3, n).astype(np.uint8) for n in rng.integers(60, 300, 3)]
        at = np.unique(rng.integers(0, 50, 9))
        m = np.sort(np.concatenate([(at << 32) + at, (at << 32) + at[::-1]]))
        m = np.unique(m)
        lines = substring_dedup._Diagonals(np.arange(3), pd.Series([t.tobytes() for t in texts]))
        a, b = texts[0], texts[2]
        for fewest in (30, 40, 60):
            side, lies, unknown = lines.passing(np.array([0]), np.array([2]), np.zeros(len(m), dtype=np.int64), m, fewest)
            assert not unknown[0] and set(side.tolist()) <= {0}
            for d in {int((v & 0xFFFFFFFF) - (v >> 32)) for v in m}:
                x = np.array([v >> 32 for v in m if (v & 0xFFFFFFFF) - (v >> 32) == d])
                places = np.arange(max(0, x.min() - 50, -d), min(x.max() + 58, len(a), len(b) - d))
                equal = a[places] == b[places + d]
                for v in x:  # a seed's words are equal
                    equal[(places >= v) & (places < v + 8)] = True
                assert equal.sum() < fewest or d in lies.tolist()
