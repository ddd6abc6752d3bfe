"""Whitening against a dense eigenvalue solver, personal data against plain patterns, resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_data import awkward, docs, words_of

from eventloom.llm import pii, queries, resampling, whitening

SAMPLE = "/root/testdata/sf0.001"


# Whitening ------------------------------------------------------------------------------------------------------------


def matrices(n):
    rng = np.random.default_rng(n)
    turn, _ = np.linalg.qr(rng.normal(size=(n, n)))
    full, thin = rng.normal(size=(n, 3 * n)), rng.normal(size=(n, max(1, n // 2)))
    spectra = [[5.0] * (n // 2) + [5 + 1e-13] + list(np.linspace(1, 2, n - n // 2 - 1)), 10.0 ** -np.arange(n), [3.0] * n]
    return [full @ full.T, thin @ thin.T, *[turn @ np.diag(s) @ turn.T for s in spectra]]


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_leading_eigenpairs(n):
    for a in matrices(n):
        a = (a + a.T) / 2
        values, vectors = whitening.leading(a, 32)
        want = np.linalg.eigvalsh(a)[::-1]
        assert len(values) == min(32, int((want > 16 * n * whitening.EPS * np.abs(a).sum(1).max()).sum()))
        assert np.allclose(values, want[: len(values)], rtol=0, atol=1e-13 * want[0])
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13
        assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-13 * want[0]
        for shift in np.linspace(-1, want[0] + 1, 9):
            if np.abs(want - shift).min() > 1e-9:
                assert whitening.above(a, shift) == (want > shift).sum()


def test_counts_follow_the_signs_of_indefinite_matrices():
    for seed in range(30):
        a = np.random.default_rng(seed).normal(size=(9, 9))
        a = a + a.T
        np.fill_diagonal(a, 0 if seed % 2 else a.diagonal())
        assert whitening.above(a, 0.0) == (np.linalg.eigvalsh(a) > 0).sum()
        f, b = whitening.Factor(a, 0.3), np.arange(9.0)
        assert np.allclose((a - 0.3 * np.eye(9)) @ f.solve(b), b)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", 1.5) for i, v in rows], "vec_id long, embedding array<float>, component int, part string, n double")


def plain(rows, components=32):
    """Whitened rows, explained shares and deviations of finite vectors of one length."""
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    v = centred.T @ centred / n
    w, q = np.linalg.eigh(v)
    w, q = w[::-1][:components], q[:, ::-1][:, :components]
    return centred @ q / np.sqrt(w), w / np.trace(v), ((n * x - s) ** 2).sum(1)


def test_whitening_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=12) * np.arange(1, 13) * 0.3 + 2]) for i in range(200)]
    rows += [(5, rows[5][1])] + [(300 + i, rows[9][1]) for i in range(100)] + [(None, rows[1][1])]
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [math.nan, *[0.0] * 11]), (904, [math.inf, *[0.0] * 11]), (905, [1.0, 2.0]), (906, [1.0, None, *[0.0] * 10])]
    table = vectors_of(spark, rows + bad).repartition(7)
    out = whitening.whitened(table).collect()
    z, explained, deviation = plain(rows)
    assert len(out) == len(rows) * 12
    want = sorted(((i is None, i or 0), k + 1, round(abs(z[r, k]), 7)) for r, (i, _) in enumerate(rows) for k in range(12))
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.component, round(abs(r.whitened), 7)) for r in out)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-6)
    assert Counter(int(r.deviation) for r in out if r.component == 1) == Counter(map(int, deviation))
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-12 and r.n == len(rows) and r.identity_error < 1e-9 for r in out)
    # One sign per component: the whitened rows are uncorrelated only then.
    first = {r.component: r.whitened for r in out if r.vec_id == 7}
    signs = {k: np.sign(first[k]) * np.sign(z[7, k - 1]) for k in first}
    assert all(abs(r.whitened * signs[r.component] - z[r.vec_id, r.component - 1]) < 1e-6 for r in out if r.vec_id is not None and r.vec_id < 200)
    again = whitening.whitened(table).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_whitening_without_variance_or_rows_and_with_great_numbers(spark):
    assert whitening.whitened(vectors_of(spark, [])).count() == 0
    assert whitening.whitened(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whitened(vectors_of(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    out = whitening.whitened(vectors_of(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()
    assert {r.component for r in out} == {1} and all(abs(r.explained - 1) < 1e-12 for r in out)
    great = whitening.whitened(vectors_of(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    u = [[2**52, 0], [-(2**52), 64], [0, 320]]
    sums = [sum(c) for c in zip(*u)]
    want = {i + 1: sum((3 * x - s) ** 2 for x, s in zip(row, sums)) for i, row in enumerate(u)}
    assert {r.vec_id: int(r.deviation) for r in great} == want
    assert all(math.isfinite(r.whitened) for r in great)


def test_registered_whitening(spark):
    out = queries.op11_whitening(spark, SAMPLE)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SAMPLE}/embeddings.parquet").collect()]
    z, explained, deviation = plain(rows)
    assert dict(out.dtypes)["deviation"] == "bigint"
    place = {i: r for r, (i, _) in enumerate(rows)}
    for r in out.collect():
        assert abs(abs(r.whitened) - abs(z[place[r.vec_id], r.component - 1])) < 1e-7
        assert r.deviation == deviation[place[r.vec_id]] and abs(r.explained - explained[r.component - 1]) < 1e-10


# Personal data --------------------------------------------------------------------------------------------------------


def plain_base(text):
    """The contract's patterns as they stand, on texts short enough for them."""
    digits = lambda t: re.sub("[^0-9]", "", t)

    def luhn(t):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(t))) % 10 == 0

    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(digits(t)) <= 19 and luhn(digits(t))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(digits(t)) <= 15),
    }
    out = [(m.start(), k, m.end()) for k, (p, good) in tests.items() for m in re.finditer(p, text) if good(m[0])]
    return [(k, s, e) for s, k, e in sorted(out, key=lambda x: (x[0], list(tests).index(x[1])))]


def luhn_number(rng, n):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    parts = ["a.b@c.d", "a@b", "@", "x_y@q-r.s", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "+1 (017) 555-7713", "+12", "+123456789012345678", "++1-2", "é", " ", "-", ".", "_", "4", "%", "\n", "４", "٣", luhn_number(rng, 16), luhn_number(rng, 19), luhn_number(rng, 14), "4111 1111 1111 1111", "4111-1111-1111-1112"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert [(k, s, e) for s, e, k in pii.base_spans(text)] == plain_base(text), text
    for _ in range(3000):
        text = "".join(rng.choice("a1.@+-_ (") for _ in range(rng.randrange(1, 40)))
        assert [(k, s, e) for s, e, k in pii.base_spans(text)] == plain_base(text), text


def test_validators():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert pii.mod_97("DE89370400440532013000") and not pii.mod_97("DE89370400440532013001")
    assert pii.routing_sum("021000021") and not pii.routing_sum("021000022")
    assert pii.ssn_parts("078-05-1120") and not any(map(pii.ssn_parts, ("000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000")))
    assert pii.global_ipv6("2606:4700:4700::1111") and not any(map(pii.global_ipv6, ("12:30:45:10", "::1", "fe80::1:2:3")))


def kinds_in(text):
    return [(k, text[s:e]) for k, s, e, *_ in pii.find(text)]


def test_further_kinds_need_their_validator_and_context():
    assert kinds_in("pay to DE89 3704 0044 0532 0130 00 AND more") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds_in("pay to DE89 3704 0044 0532 0130 01 AND more") == []
    assert kinds_in("XX12 GB82 WEST 1234 5698 7654 32") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds_in("his SSN is 123-45-6789.") == [("ssn", "123-45-6789")] and kinds_in("part 123-45-6789.") == []
    assert kinds_in("call (555) 123-4567 now") == [("tel", "(555) 123-4567")] and kinds_in("sum 555-123-4567 left") == []
    assert kinds_in("sample call (555) 123-4567") == []  # a word against it
    assert kinds_in("phone +1 (555) 123-4567") == [("phone", "+1 (555) 123-4567")]  # the base span keeps its place
    assert kinds_in("bank routing 021000021") == [("routing", "021000021")] and kinds_in("bank routing 021000022") == []
    assert kinds_in("host 2606:4700:4700:0:0:0:0:1111 up") == [("ipv6", "2606:4700:4700:0:0:0:0:1111")] and kinds_in("at 12:30:45:10") == []
    near, far = (pii.find(t)[0][3] for t in ("visa 4111 1111 1111 1111", "test 4111 1111 1111 1111"))
    assert near > far and pii.redact("mail a@b.co or 1.2.3.4!", pii.find("mail a@b.co or 1.2.3.4!")) == "mail [EMAIL] or [IP]!"


def test_long_texts_take_linear_time():
    for unit in ("x", "1", "1.", "a@", "+1", "1 ", "A1", "DE89 3704 ", "1:", "a.b@c-", "555-123-"):
        pii.find(unit * (400_000 // len(unit)))


def test_personal_data_of_a_table(spark):
    rng = random.Random(1)
    rows = [(i, " ".join([*words_of(i, 20), rng.choice(["a.b@mail3.example.com", "97.51.17.173", luhn_number(rng, 16), "+1 (017) 555-7713", "none"]), *words_of(i + 1, 20)])) for i in range(60)]
    rows += [(i, t) for i, t, *_ in awkward()] + [(7, "repeated a@b.c"), (None, "1.2.3.4")]
    out = pii.find_personal_data(docs(spark, rows)).collect()
    want = Counter((i, tuple(plain_base(t or ""))) for i, t in rows if t is None or len(t) < 20_000)
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.base)) for r in out)
    assert len(out) == len(rows) and not want - got
    assert pii.find_personal_data(docs(spark, [])).count() == 0
    cleaned = {r.doc_id: r.text for r in pii.redacted(docs(spark, [(1, "to a@b.c"), (2, None), (3, "")])).collect()}
    assert cleaned == {1: "to [EMAIL]", 2: None, 3: ""}


def test_registered_personal_data(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    for r in queries.op12_pii(spark, SAMPLE).collect():
        base = plain_base(texts[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple([k for k, *_ in base].count(k) for k in pii.BASE)
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


# Resampling -----------------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, max_n):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, max_n=1, buckets=10_000, percent=10, least=20):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    source, aim = (Counter(place(f) for t in texts for f in plain_features(t, max_n)[1]) for texts in ([t for _, t in rows], target))
    s_all, t_all = sum(source.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))
    out = []
    for i, t in rows:
        n, found = plain_features(t, max_n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(f)) for f in found)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = able[: percent * len(able) // 100]
    ranks = Counter((x[0], x[2], x[3], x[4], r + 1) for r, x in enumerate(drawn))
    return ranks, Counter(x[:1] + x[2:] for x in out) - Counter(x[:1] + x[2:] for x in drawn)


def check_resample(spark, rows, target, **options):
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(target)], "item_id long, text string, score string, row long")
    out = resampling.resample(docs(spark, rows).repartition(5), bench, **options).collect()
    plain_names = {"percent": "percent", "least_words": "least", "max_n": "max_n", "buckets": "buckets"}
    ranks, rest = plain_resample(rows, target, **{plain_names[k]: v for k, v in options.items() if k in plain_names})
    key = lambda r: (r.doc_id, r.n_features, r.weight, r.score)
    assert sorted(r.rank for r in out if r.rank) == list(range(1, sum(ranks.values()) + 1))
    assert Counter(key(r) for r in out if r.rank is None) == rest
    assert Counter((*key(r), r.rank) for r in out if r.rank) == ranks


def corpus():
    rng = random.Random(2)
    rows = [(i, " ".join(words_of(i % 50, rng.randrange(5, 60)))) for i in range(300)] + [(i, t) for i, t, *_ in awkward()]
    return rows, [" ".join(words_of(i, 30)) for i in range(6)] + [None, ""]


def test_resampling_equals_a_plain_version(spark):
    rows, target = corpus()
    check_resample(spark, rows, target)
    check_resample(spark, rows, target, percent=63, least_words=3, accuracy=20)
    check_resample(spark, rows, target, max_n=3, buckets=77)
    check_resample(spark, rows, [], percent=100)
    check_resample(spark, rows, target, percent=0)


def test_resampling_with_many_ties(spark):
    """A third of all rows is one row over and over, so a tie crosses the cutoff."""
    rows, target = corpus()
    same = (5000, " ".join(words_of(1, 30)))
    for percent in (5, 30, 60, 90):
        check_resample(spark, rows + [same] * 170, target, percent=percent, accuracy=10)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs(spark, []), empty).count() == 0


def test_pieces_of_a_long_text_hold_the_same_features(monkeypatch):
    text = " ".join(words_of(4, 3000)) + "é" * 500
    for max_n in (1, 3):
        n, found = plain_features(text, max_n)
        for piece in (64, 1000, 1 << 20):
            monkeypatch.setattr(resampling, "PIECE", piece)
            parts = list(resampling.features(text.encode(), max_n, 500))
            assert sum(p[0] for p in parts) == n
            assert Counter(np.concatenate([p[1] for p in parts]).tolist()) == Counter(zlib.crc32(f.encode()) % 500 for f in found)
