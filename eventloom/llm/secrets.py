"""Secret scans: fixed patterns plus a character-level convolutional network over every candidate and its surroundings.

The base patterns always count. Besides, each long unbroken string is a candidate, or what base spans leave of it: the
network reads its characters with those around it and its score decides, against a threshold that keeps a wanted recall on labelled findings that
were held out of training. Labelled findings are the different candidates of all documents (those that a base pattern covers
are positive, the others negative) and keys of known shapes written into the places of all of them. The network is fitted
in rounds: each task goes on from the same network over its own findings, and the mean of what they come to starts the
next round.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.common import FIXED, as_fixed, batches_of_texts, learning_set, stored, stored_counting, summed, text_or_empty

# The base patterns and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the least length can stand in the pattern
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: Least characters of what base spans leave of a candidate.
PART_CHARS = 12
SIDE, INSIDE = 24, 48
WIDTH = INSIDE + 2 * SIDE


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate in steps of INSIDE characters, each with SIDE characters before and after."""
    out = []
    for at in range(start, end, INSIDE):
        left, right = max(0, at - SIDE), min(len(text), min(at + INSIDE, end) + SIDE)
        out.append((" " * (SIDE - (at - left)) + text[left:right]).ljust(WIDTH)[:WIDTH])
    return out


class CharNet:
    """Characters to vectors, filters of several widths, greatest response of each, logistic output."""

    SIZES, FILTERS, DIMS, CHARS = (2, 4, 6), 12, 8, 97

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.3, (self.CHARS, self.DIMS)), "v": rng.normal(0, 0.3, len(self.SIZES) * self.FILTERS), "c": np.zeros(1)}
        for w in self.SIZES:
            self.p[f"w{w}"] = rng.normal(0, (w * self.DIMS) ** -0.5, (w * self.DIMS, self.FILTERS))
            self.p[f"b{w}"] = np.zeros(self.FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.threshold = 1.0

    @classmethod
    def codes(cls, texts: list[str]) -> np.ndarray:
        """Printable ASCII to 0..94, other white space and other characters to one code each."""
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, WIDTH)
        return np.where((raw >= 32) & (raw < 127), raw - 32, np.where(raw < 32, 95, 96)).astype(np.int64)

    def _forward(self, codes: np.ndarray):
        x = self.p["e"][codes]
        feats, best = [], []
        for w in self.SIZES:
            n = WIDTH - w + 1
            wide = np.concatenate([x[:, j : j + n] for j in range(w)], axis=2)
            z = wide @ self.p[f"w{w}"] + self.p[f"b{w}"]
            at = z.argmax(1)
            best.append((wide, at))
            feats.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        z = np.concatenate(feats, 1)
        h = np.maximum(z, 0)
        return h, z, best, h @ self.p["v"] + self.p["c"]

    def scores(self, texts: list[str]) -> np.ndarray:
        out = [1 / (1 + np.exp(-self._forward(self.codes(texts[i : i + 512]))[3])) for i in range(0, len(texts), 512)]
        return np.concatenate(out) if out else np.zeros(0)

    def epoch(self, texts: list[str], labels: np.ndarray, weigh: dict[int, float], seen: dict[str, np.ndarray], rng: np.random.Generator, rate: float = 0.05) -> None:
        """Adagrad on the logistic loss, once over the texts; seen holds the sums of squared gradients."""
        codes, weight = self.codes(texts), np.where(labels == 1, weigh[1], weigh[0])
        order = rng.permutation(len(texts))
        for i in range(0, len(order), 128):
            part = order[i : i + 128]
            h, z, best, logit = self._forward(codes[part])
            d = ((1 / (1 + np.exp(-logit)) - labels[part]) * weight[part] / len(part)).astype(np.float32)
            grad = {"v": h.T @ d, "c": d.sum(keepdims=True), "e": np.zeros_like(self.p["e"])}
            dz = d[:, None] * self.p["v"] * (z > 0)
            for k, (w, (wide, at)) in enumerate(zip(self.SIZES, best)):
                g = dz[:, k * self.FILTERS : (k + 1) * self.FILTERS]
                rows = np.arange(len(part))[:, None]
                picked = wide[rows, at]
                grad[f"w{w}"] = np.einsum("nfd,nf->df", picked, g)
                grad[f"b{w}"] = g.sum(0)
                back = np.einsum("nf,df->nfd", g, self.p[f"w{w}"]).reshape(*g.shape, w, self.DIMS)
                for j in range(w):
                    places = codes[part][rows, at + j][..., None] * self.DIMS + np.arange(self.DIMS)
                    grad["e"] += np.bincount(places.ravel(), back[:, :, j].ravel(), grad["e"].size).reshape(grad["e"].shape).astype(np.float32)
            for k, g in grad.items():
                seen[k] += g * g
                self.p[k] -= rate * g / np.sqrt(seen[k])


def fitted(findings: DataFrame, epochs: int, seed: int = 6) -> CharNet | None:
    """A network fitted on all findings (window, label), in one round an epoch; None without both labels.

    Classes are weighed alike. A round gives the driver one row per parameter, however many findings there are.
    """
    size = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    if len(size) < 2:
        return None
    weigh = {label: sum(size.values()) / 2 / n for label, n in size.items()}
    spark, net = findings.sparkSession, CharNet()
    seen = {k: np.full_like(v, 1e-3) for k, v in net.p.items()}
    for turn in range(epochs):
        shared = spark.sparkContext.broadcast((net.p, seen))

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start, start_seen = shared.value
            own, own_seen = CharNet(), {k: v.copy() for k, v in start_seen.items()}
            own.p = {k: v.copy() for k, v in start.items()}
            rng, any_rows = np.random.default_rng([seed, turn]), False
            for batch in batches:
                any_rows = any_rows or len(batch) > 0
                own.epoch(batch["window"].tolist(), batch["label"].to_numpy(), weigh, own_seen, rng)
            if any_rows:
                moves = np.concatenate([(own.p[k] - start[k]).ravel() for k in start])
                squares = np.concatenate([(own_seen[k] - start_seen[k]).ravel() for k in start])
                yield pd.DataFrame({"place": np.arange(len(moves)), "move": as_fixed(moves), "square": as_fixed(squares)})

        sums = summed(findings.select("window", "label").mapInPandas(learn, "place long, move long, square long"), "place")
        order = np.argsort(sums["place"])
        moves, squares = (sums[c][order] / sums["n"][order] / FIXED for c in ("move", "square"))
        at = 0
        for k, v in net.p.items():
            net.p[k] = (v + moves[at : at + v.size].reshape(v.shape)).astype(np.float32)
            seen[k] = (seen[k] + squares[at : at + v.size].reshape(v.shape)).astype(np.float32)
            at += v.size
        shared.unpersist()
    return net


_SHAPES = (
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 20, 48),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 24, 64),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", 22, 44),
    ("0123456789abcdef", 32, 64),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 40),
)


def _made_finding(around: str, turn: int) -> str:
    """A random key of a known shape in place of the candidate of a window, the same for the same window and turn."""
    rng = np.random.default_rng([7, turn, zlib.crc32(around.encode("utf-8", "surrogatepass"))])
    letters, least, most = _SHAPES[int(rng.integers(len(_SHAPES)))]
    key = "".join(letters[i] for i in rng.integers(len(letters), size=rng.integers(least, most + 1)))
    text = around[:SIDE] + key + around[-SIDE:]
    return windows(text, SIDE, SIDE + len(key))[0]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of the candidates that no base span touches and, of the others, of what base spans leave uncovered."""
    covered: list[list[int]] = []
    for start, end, _ in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    ends = [end for _, end in covered]
    out = []
    for m in CANDIDATE.finditer(text):
        at, last = m.span()
        for start, end in takewhile(lambda c: c[0] < last, islice(covered, bisect_right(ends, at), None)):
            if start - at >= PART_CHARS:
                out.append((at, start))
            at = end
        if last - at >= PART_CHARS:
            out.append((at, last))
    return out


def _labelled(text: str) -> list[tuple[str, int]]:
    """Windows of base spans as findings, those of candidates without any as none; parts beside a base span have no label."""
    base = base_spans(text)
    out = [(w, 1) for s, e, _ in base for w in windows(text, s, e)]
    whole = {m.span() for m in CANDIDATE.finditer(text)}
    return out + [(w, 0) for s, e in candidates(text, base) if (s, e) in whole for w in windows(text, s, e)]


def _share(salt: str, of: int) -> Column:
    """0 to of - 1, by the hash of the window."""
    return F.pmod(F.xxhash64(F.lit(salt), "window"), F.lit(of))


def _scored(findings: DataFrame, net: CharNet) -> DataFrame:
    """window, label, score."""
    shared = findings.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=shared.value.scores(batch["window"].tolist()).astype(np.float64))

    return findings.select("window", "label").mapInPandas(score, "window string, label int, score double")


def without_doubtful(findings: DataFrame, doubt: float = 0.5) -> DataFrame:
    """The findings less the negative ones that a network fitted on the other half of all findings takes for positive.

    A key that no base pattern finds stands among the candidates without label; learnt as negative it would hide others.
    """
    half = _share("half", 2)
    out = findings.where("label = 1")
    for own in (0, 1):
        net = fitted(findings.where(half != own), epochs=6)
        if net is None:
            return findings
        out = out.union(_scored(findings.where((F.col("label") == 0) & (half == own)), net).where(F.col("score") < doubt).select("window", "label"))
    return out


def train(docs: DataFrame, recall: float = 0.98, rows_a_file: int = 8_000) -> CharNet | None:
    """Fits the network on the findings of all documents; a file of findings, of about rows_a_file, is a task's share of a round.

    The threshold is the highest, to 1 / 65,536, that keeps the wanted share of the held-out positive windows (a quarter of all).
    Without candidates that no base pattern touches there is no network, and only base patterns count.
    """
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for t in batch["content"] for x in _labelled(t)], columns=["window", "label"])

    real = stored(docs.select(text_or_empty().alias("content")).mapInPandas(label, "window string, label int").distinct(), "candidates")
    size = {r["label"]: r["count"] for r in real.groupBy("label").count().collect()}
    if not size.get(0):
        return None
    times = -(-max(size[0], 500) // sum(size.values()))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_made_finding(w, i) for w in batch["window"] for i in range(times)]
            yield pd.DataFrame({"window": found, "label": np.ones(len(found), dtype=np.int64)})

    every = real.union(real.select("window").mapInPandas(made, "window string, label int"))
    findings = learning_set(every, "window", sum(size.values()) * (1 + times), rows_a_file, "findings")
    clear, n = stored_counting(without_doubtful(findings), "clear", F.col("label") == 0)
    if not n:  # all are doubtful
        clear = findings
    clear = learning_set(clear, "window", sum(size.values()) * (1 + times), rows_a_file, "clear")
    rest = _share("rest", 4) == 0
    net = fitted(clear.where(~rest), epochs=12)
    if net is None:
        return None
    bins = _scored(clear.where(rest & (F.col("label") == 1)), net).groupBy(F.floor(F.col("score") * 65_536).alias("bin")).count().orderBy("bin").collect()
    passed, net.threshold = 0, 0.5
    wanted = int((1 - recall) * (sum(r["count"] for r in bins) - 1) + 1e-9)
    for r in bins:
        passed += r["count"]
        if passed > wanted:
            net.threshold = r["bin"] / 65_536
            break
    return net


def scan(texts: list[str], net: CharNet | None) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """For each text its base spans, and the candidates at or over the threshold as spans of kind model."""
    base = [base_spans(t) for t in texts]
    more: list[list] = [[] for _ in texts]
    if net is not None:
        found = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t, base[i])]
        cut = [windows(texts[i], s, e) for i, s, e in found]
        scores = net.scores([w for c in cut for w in c])
        begin = 0
        for (i, s, e), c in zip(found, cut):
            if scores[begin : begin + len(c)].max() >= net.threshold:
                more[i].append((s, e, "model"))
            begin += len(c)
    return list(zip(base, more))


def _written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, net: CharNet | None = None, **training) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text is empty and has no spans; repeated rows and rows without identifier are scanned like others; an empty table
    gives none. spans lists base and added ones as kind:start:end, end exclusive.
    """
    net = net or train(docs, **training)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, texts = [], batch["content"].tolist()
            ids = batch["doc_id"].astype("Int64").tolist()
            for at, end in batches_of_texts(batch["content"].str.len().to_numpy()):
                for doc, (base, more) in zip(ids[at:end], scan(texts[at:end], net)):
                    kinds = [k for *_, k in base]
                    every = sorted(base + more, key=lambda s: (s[0], (*KINDS, "model").index(s[2])))
                    rows.append((doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("content"))
    return rows.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
