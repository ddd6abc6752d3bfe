import hashlib
import itertools
import random
import re
import zlib

import numpy as np
from llm_data import awkward, docs, words_of

from eventloom.llm import decontamination, secrets, toxicity

BAD = ["grimble", "foulword", "nastyterm", "vileword", "hexname"]


def labelled(spark, n=600):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        w = words_of(10_000 + i, rng.randrange(5, 80), 3000)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic), "x"))
    return rows, spark.createDataFrame(labels + [(1, 1, None, "x"), (None, 1, 1, "x"), (4, 0, 1, "x")], "doc_id long, quality int, toxic int, content string")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    more = [(5000, None), (5001, ""), (5002, " \n"), (None, "no id"), (5003, " ".join(words_of(3, 20000, 5000))), (5003, "again"), (0, rows[0][1])]
    out = toxicity.toxicity(docs(spark, rows + more), labels).collect()
    assert len(out) == len(rows) + len(more)
    right = [r.predicted == (r.doc_id % 4 == 0) for r in out if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert np.mean(right) > 0.97
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.doc_id is None or r.doc_id < 5000 or not r.predicted
    again = toxicity.toxicity(docs(spark, rows + more), labels)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in again.collect()) == sorted((str(r.doc_id), round(r.score, 6)) for r in out)


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = labelled(spark, 20)
    assert {r.score for r in toxicity.toxicity(docs(spark, rows), labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0
    assert toxicity.toxicity(docs(spark, rows), labels.limit(0)).where("predicted = 1").count() == 0


def test_language_comes_from_the_text():
    from eventloom.llm.common import _OTHER, word_hashes

    tell = lambda t: toxicity.language(word_hashes([t], _OTHER)[0])
    assert [tell("The cat and the dog"), tell("der Hund und die Katze"), tell("le chat et les chiens"), tell("el gato y los perros"), tell("xyz"), tell("")] == ["en", "de", "fr", "es", "other", "other"]


def plain_base(text):
    """The contract's patterns, one by one."""
    out = []
    for kind, pattern, least, group in (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2), ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]+", 16, 0),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    out.sort(key=lambda x: (x[0], ["assign", "access", "hex"].index(x[1])))
    return ",".join(f"{k}:{s}:{e}" for s, k, e in out), [k for _, k, _ in out]


def test_secret_spans(spark):
    rng = random.Random(6)
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, letters = "0123456789abcdef", "ABCDEFGHabcdefgh0123456789+/"
    texts = ["token=secret:abcdefghijklmnop", "TOKEN  = 'abcdefghijkl'", "api_key:short", "AKIA" + "Z" * 14, "AKIAZZ akiaAKIA" + "Q" * 20, "ſecret=abcdefghijklmnopq", "é " * 40 + "password: " + key(letters, 30), "f" * 70000, "mail8.example.com and mail9.example.com"]
    for i in range(300):
        w = words_of(i, 40)
        w.insert(rng.randrange(40), rng.choice([f"token = \"{key(hexes, 40)}\"", key(hexes, 16), f"mail{i}.example.com", key(letters, 33), "ordinarylongwordwithoutanykey", "AKIA" + key("ABCDEFGH0123", 16)]))
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t, *_ in awkward() if i is not None and i >= 900]
    out = secrets.find_secrets(docs(spark, rows + [(None, texts[0])])).collect()
    assert len(out) == len(rows) + 1
    wanted = {}
    for i, t in rows:
        wanted.setdefault(i, []).append(plain_base(t or ""))
    for r in out:
        if r.doc_id is not None:
            hashes = {hashlib.sha256(w.encode()).hexdigest(): (w, kinds) for w, kinds in wanted[r.doc_id]}
            written, kinds = hashes[r.base_sha256]
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, ("assign", "access", "hex")))
            assert set(written.split(",")) <= set(r.spans.split(",")) or not written
    assert any("model" in r.spans for r in out)
    assert secrets.find_secrets(docs(spark, [])).count() == 0


def test_parts_of_candidates_beside_base_spans():
    key, hexes = "Zq8Xv2Lm9Rt4Kp7WyB3n", "0123456789abcdef"
    text = f"see https.hooks/{hexes}/{key} or {key}{hexes}{key} and {hexes} or ab/{hexes}/cd plain_{key}"
    base = secrets.base_spans(text)
    parts = [text[s:e] for s, e in secrets.candidates(text, base)]
    assert parts == ["https.hooks/", f"/{key}", key, key, f"plain_{key}"]
    assert secrets.candidates(text, [(0, len(text), "assign")]) == []
    assert [text[s:e] for s, e in secrets.candidates(text, [])][0] == f"https.hooks/{hexes}/{key}"
    rng = random.Random(2)
    for _ in range(300):  # no part touches a base span, and all else of a candidate is in parts unless short
        text = "".join(rng.choice(["abc", "0123456789abcdef", " ", "token=" + "k" * 13, "xyz.Q", "AKIA" + "7" * 15, "/"]) for _ in range(12))
        base = secrets.base_spans(text)
        taken = {i for s, e, _ in base for i in range(s, e)}
        want = []
        for m in secrets.CANDIDATE.finditer(text):
            for free, places in itertools.groupby(range(*m.span()), lambda i: i not in taken):
                places = list(places)
                if free and len(places) >= secrets.PART_CHARS:
                    want.append((places[0], places[-1] + 1))
        assert secrets.candidates(text, base) == want


def test_precision_and_recall_of_added_secrets(spark):
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = lambda i: rng.choice([f"mail{i}.example.com/inbox", f"/usr/share/lib/module{i}.py", "Donaudampfschifffahrts" + words_of(i, 1)[0], f"docs.example.org/page{i}.html", "=" * 20])
    rows, keys = [], {}
    for i in range(1200):
        w = words_of(i, 30)
        w.insert(5, plain(i))
        if i % 6 == 0:
            w.insert(15, f'token = "{"".join(rng.choice(letters) for _ in range(30))}"')
        if i % 4 == 1:
            keys[i] = "".join(rng.choice(letters) for _ in range(rng.randrange(24, 44)))
            w.insert(20, keys[i])
        rows.append((i, " ".join(w)))
    out = secrets.find_secrets(docs(spark, rows)).collect()
    texts, right, wrong = dict(rows), set(), 0
    for r in out:
        for span in filter(lambda s: s.startswith("model"), r.spans.split(",")):
            _, s, e = span.split(":")
            if texts[r.doc_id][int(s) : int(e)] == keys.get(r.doc_id):
                right.add(r.doc_id)
            else:
                wrong += 1
    assert len(right) >= 0.9 * len(keys) and wrong <= 0.05 * len(right)


def test_benchmark_passages_with_substitutions(spark):
    items = {i: [f"q{i}x{j}" for j in range(20 + i)] for i in range(12)}
    bench = spark.createDataFrame([(i, " ".join(w), "x", 1) for i, w in items.items()] + [(50, None, "x", 1), (51, "", "x", 1), (None, "z z z z z z", "x", 1), (52, "just four words here", "x", 1), (53, "exactly six little words are here", "x", 1)], "item_id long, text string, content string, words long")
    swap = lambda w, places: [f"s{j}" if j in places else x for j, x in enumerate(w)]
    fill = words_of(1, 30)
    rows = [
        (1, " ".join(fill + items[0] + fill)), (2, " ".join(fill + swap(items[1], {4, 11, 17}) + fill)), (3, " ".join(items[2][:14])), (4, " ".join(items[3][:9] + fill)),
        (5, " ".join(fill)), (6, ", ".join(items[4]).upper()), (7, None), (8, ""), (None, " ".join(items[0])), (9, " ".join(words_of(5, 5000) + items[5] + items[6])),
        (10, "just four words here"), (11, "It has exactly six little words are here."), (12, " ".join(swap(items[7], set(range(0, 27, 2))))), (13, "the end"), (13, " ".join(items[8])),
    ]
    found = decontamination.contaminated(docs(spark, rows), bench)
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.equal_words) for r in found.collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2), (6, 4), (9, 5), (9, 6), (11, 53), (13, 8)}
    assert got[1, 0] == (30, 20, 20) and got[2, 1] == (30, 21, 18) and got[3, 2] == (0, 14, 14)
    kept = decontamination.without_contaminated(docs(spark, rows), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["4", "5", "7", "8", "None", "10", "12"])
    assert decontamination.contaminated(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.contaminated(docs(spark, []), bench).count() == 0


def test_longest_overlap_equals_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        equal = np.array([rng.random() < 0.7 for _ in range(rng.randrange(1, 30))])
        s, e = decontamination.longest_overlap(equal, 0.8)
        sizes = [j - i for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if equal[i] and equal[j - 1] and equal[i:j].mean() >= 0.8 - 1e-9]
        assert (e - s >= max(sizes) and equal[s:e].mean() >= 0.8 - 1e-9) if sizes else e == s


def test_masks_hit_every_accepted_stretch():
    def missed(n, changes, masks):
        """Placings of changed words between equal ends that no mask fits."""
        bits = [(int(m, 2) << o) for m in masks for o in range(n - len(m) + 1)]
        lines = ((1 << n) - 1 - sum(1 << j for j in places) for places in itertools.combinations(range(1, n - 1), changes))
        return sum(all(line & b != b for b in bits) for line in lines)

    for n in range(decontamination.LEAST_WORDS, 13):
        assert missed(n, n // 5, decontamination._masks(n)) == 0
    assert all(missed(n, n // 5, decontamination.MASKS) == 0 for n in range(13, 21))
    # Longer ones: the most equal words of any line without a hit, by its last words.
    size = max(map(len, decontamination.MASKS)) - 1
    best = {1: 1}
    for n in range(2, 121):
        after = {}
        for last, equal in best.items():
            for bit in (0, 1):
                line = last << 1 | bit
                if all(line & int(m, 2) != int(m, 2) for m in decontamination.MASKS):
                    key = line & ((1 << size) - 1)
                    after[key] = max(after.get(key, 0), equal + bit)
        best = after
        assert n < 13 or max(v for k, v in best.items() if k & 1) < 0.8 * n
    assert max(best.values()) + 12 < 0.8 * 132  # so no longer one is missed either, block by block


def test_substitutions_in_short_items_and_in_the_least_stretch(spark):
    items = {n: [f"i{n}x{j}" for j in range(n)] for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 15)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    rows, want = [], set()
    for n, w in items.items():
        for k, places in enumerate(itertools.combinations(range(1, n - 1), n // 5)):
            rows.append((n * 1000 + k, " ".join(["before"] * 3 + [f"s{j}" if j in places else x for j, x in enumerate(w)] + ["after"])))
            want.add((n * 1000 + k, n, 3, n, n - n // 5))
    found = decontamination.contaminated(docs(spark, rows), bench)
    assert {(r.doc_id, r.item_id, r.start_word, r.n_words, r.equal_words) for r in found.collect()} == want


def test_secrets_are_learnt_from_all_documents(spark, monkeypatch):
    rng = random.Random(8)
    keys = ["".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(20)) for _ in range(4500)]
    rows = [(i, f"w{i} {'token=' if i % 9 == 0 else ''}{k}") for i, k in enumerate(keys)]
    seen = []
    monkeypatch.setattr(secrets, "fitted", lambda findings, epochs, **_: seen.append({r.window for r in findings.select("window").collect()}))
    assert secrets.train(docs(spark, rows)) is None
    last = seen[-1]
    found = {w for _, t in rows for s, e in [(t.index(" ") + 1, len(t))] for w in secrets.windows(t, s, e)}
    kept = spark.createDataFrame([(w,) for w in found], "window string").where(secrets._share("rest", 4) != 0)
    assert {r.window for r in kept.collect()} <= last  # all but the quarter that sets the threshold


def test_rounds_of_several_files_learn_what_one_does(spark):
    rng = random.Random(9)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, f"see {word('abcdefghijklmnop', 24) if i % 2 else 'secret=' + word('ABCDEFGHJK0123456789', 30)} here") for i in range(900)]
    net = secrets.train(docs(spark, rows), rows_a_file=400)
    texts = [f"see {word('abcdefghijklmnop', 24)} here" for _ in range(50)] + [f"see {word('ABCDEFGHJK0123456789', 30)} here" for _ in range(50)]
    found = [bool(more) for _, more in secrets.scan(texts, net)]
    assert sum(found[:50]) <= 10 and sum(found[50:]) >= 40
    assert net.threshold == secrets.train(docs(spark, rows), rows_a_file=400).threshold


def test_toxicity_is_learnt_from_all_labelled_rows(spark, monkeypatch):
    rows = [(i, f"text number n{i} with a word or two") for i in range(9000)] + [(3, "text number n3 with a word or two")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(9000)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity.TextNet, "fit", lambda self, rows, share: seen.append({r.doc_id for r in rows.select("doc_id").collect()}))
    monkeypatch.setattr(toxicity.TextNet, "calibrate", lambda self, rows: seen.append({r.doc_id for r in rows.select("doc_id").collect()}))
    toxicity.train(docs(spark, rows), labels)
    assert not seen[0] & seen[1] and seen[0] | seen[1] == {i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_toxicity_in_rounds_of_several_files(spark):
    rows, labels = labelled(spark, 900)
    net = toxicity.train(docs(spark, rows), labels, texts_a_file=100)
    again = toxicity.train(docs(spark, rows), labels, texts_a_file=100)
    assert (net.tables == again.tables).all() and net.level == again.level
    out = toxicity.toxicity(docs(spark, rows), net=net).where("held_out").collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in out]) > 0.97
