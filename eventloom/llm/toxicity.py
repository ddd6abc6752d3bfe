"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

A word is the sum of what two hash tables hold for it, half of its vector each, so that two words meet in both only by
a rare chance. Filters of one, two and three words slide over the text, each gives its greatest response, and a logistic
unit weighs them. The first number of each table entry starts as the bucket's smoothed log odds in the training texts;
words that were not seen stay near zero.

All labelled texts outside the held-out third are used. The counts of the buckets are summed over all of them, and the
network is fitted in rounds: each task goes on from the same network over its own texts, and the mean of its moves (of a table
entry: over the tasks that moved it) starts the next round. The driver holds the network and one row per entry, however many texts there are.

Scores are calibrated by language, which is told from common words of the text itself: on labelled texts that were held
out of training, each language gets the threshold with the best F-measure, and the score is shifted so that this
threshold lies at CUT.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.common import FIXED, _OTHER, as_fixed, batches_of_texts, learning_set, lower_ascii, released, small_side, stored, summed, text_or_empty, word_hashes

CUT = 0.7
WIDTHS = (1, 2, 3)

# Common words that tell languages apart.
COMMON_WORDS = {
    "en": "the of and to in is that was for with this are",
    "de": "der die das und ist nicht mit den ein von zu sich",
    "fr": "le la les et des est dans une pour que sur un",
    "es": "el los y que las por con una para del se su",
}


class TextNet:
    def __init__(self, bits: int = 18, dims: int = 6, filters: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bits, self.dims, self.filters = bits, dims, filters
        self.tables = rng.normal(0, 0.01, (2, 1 << bits, dims)).astype(np.float32)
        self.weights = rng.normal(0, 0.2, (2 * dims, sum(WIDTHS) * filters)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * filters, dtype=np.float32)
        self.out = np.full(len(WIDTHS) * filters, 0.1, dtype=np.float32)
        self.shift = np.zeros(1, dtype=np.float32)
        self.levels: dict[str, float] = {}
        self.level = 0.0
        # The first filter of each width starts as the sum of both log odds, averaged over its words.
        for w, at in self._places():
            self.weights[0, at] = self.weights[dims, at] = 0.5
            self.out[WIDTHS.index(w) * filters] = 1.0

    def _places(self) -> Iterator[tuple[int, int]]:
        at = 0
        for w in WIDTHS:
            for _ in range(w):
                yield w, at
                at += self.filters

    def buckets(self, words: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        return np.stack([words & mask, (words >> np.uint64(32)) & mask]).astype(np.int64)

    def _pooled(self, words: np.ndarray, places: np.ndarray, keep: bool = False):
        """Greatest responses (texts, filters), and with keep the words' vectors and the places of the responses."""
        buckets = self.buckets(words)
        vectors = np.concatenate([self.tables[0][buckets[0]], self.tables[1][buckets[1]]], axis=1)
        responses = vectors @ self.weights
        n, f = len(places) - 1, self.filters
        pooled = np.zeros((n, len(WIDTHS) * f), dtype=np.float32)
        where = np.full((n, len(WIDTHS) * f), -1, dtype=np.int64)
        at = 0
        for k, w in enumerate(WIDTHS):
            size = len(words) - w + 1
            if size > 0:
                z = sum(responses[j : j + size, at + j * f : at + (j + 1) * f] for j in range(w)) / w
            at += w * f
            for i in range(n):
                start, end = places[i], places[i + 1] - w + 1
                if end > start:
                    part = z[start:end]
                    if keep:
                        best = part.argmax(0)
                        where[i, k * f : (k + 1) * f] = best + start
                        pooled[i, k * f : (k + 1) * f] = part[best, np.arange(f)]
                    else:
                        pooled[i, k * f : (k + 1) * f] = part.max(0)
        return (pooled, where, vectors, buckets) if keep else pooled

    def logits(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.maximum(self._pooled(words, places) + self.bias, 0) @ self.out + self.shift[0]

    def dense(self) -> tuple[np.ndarray, ...]:
        return self.weights, self.bias, self.out, self.shift

    def start_tables(self, half: np.ndarray, bucket: np.ndarray, positive: np.ndarray, negative: np.ndarray, share: float, pseudo: float = 10.0) -> None:
        """Smoothed log odds of each bucket from the numbers of texts that hold it."""
        counts = np.zeros((2, 2, 1 << self.bits))
        counts[1, half, bucket], counts[0, half, bucket] = positive, negative
        odds = np.log((counts[1] + pseudo * share) / (counts[0] + pseudo * (1 - share))) - np.log(share / (1 - share))
        self.tables[:, :, 0] = odds.astype(np.float32)
        self.shift[:] = np.log(share / (1 - share))

    def epoch(self, texts: list[np.ndarray], labels: np.ndarray, seen: list[np.ndarray], past: np.ndarray, rng: np.random.Generator, rate: float = 0.03) -> None:
        """Adagrad on the logistic loss, once over the texts; gradients reach only the words where a filter was greatest.
        seen (as dense) and past (as tables) hold the sums of squared gradients."""
        d, f = self.dims, self.filters

        def step(array, squares, grad):
            squares += grad * grad
            array -= rate * grad / np.sqrt(squares)

        order = rng.permutation(len(texts))
        for i in range(0, len(order), 64):
            part = order[i : i + 64]
            words = np.concatenate([texts[j] for j in part])
            places = np.cumsum([0, *(len(texts[j]) for j in part)])
            pooled, where, vectors, buckets = self._pooled(words, places, keep=True)
            z = pooled + self.bias
            h = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-(h @ self.out + self.shift[0])))
            g = ((p - labels[part]) / len(part)).astype(np.float32)
            dz = g[:, None] * self.out * (z > 0) * (where >= 0)
            grad_w = np.zeros_like(self.weights)
            touched, moves = [], []
            at = 0
            for k, w in enumerate(WIDTHS):
                for j in range(w):
                    for c in range(f):
                        col, rows = k * f + c, np.flatnonzero(dz[:, k * f + c])
                        if len(rows):
                            pos, amount = where[rows, col] + j, dz[rows, col] / w
                            grad_w[:, at + c] += vectors[pos].T @ amount
                            touched.append(pos)
                            moves.append(amount[:, None] * self.weights[:, at + c])
                    at += f
            for array, squares, grad in zip(self.dense(), seen, (grad_w, dz.sum(0), h.T @ g, g.sum(keepdims=True))):
                step(array, squares, grad)
            if touched:
                pos, move = np.concatenate(touched), np.concatenate(moves)
                for half in range(2):
                    ids, back = np.unique(buckets[half][pos], return_inverse=True)
                    grad = np.zeros((len(ids), d), dtype=np.float32)
                    np.add.at(grad, back, move[:, half * d : (half + 1) * d])
                    past[half, ids] += grad * grad
                    self.tables[half, ids] -= rate * grad / np.sqrt(past[half, ids])

    def moves(self, start: TextNet, seen: list[np.ndarray], start_seen: list[np.ndarray]) -> pd.DataFrame:
        """What differs from start, as whole numbers: part 0 and 1 are entries of the tables, part 2 all else, with the
        squares in the second column."""
        out = []
        for half in range(2):
            ids = np.flatnonzero((self.tables[half] != start.tables[half]).any(1))
            values = as_fixed(self.tables[half, ids] - start.tables[half, ids])
            out.append(pd.DataFrame({"part": half, "entry": ids, **{f"d{i}": values[:, i] for i in range(self.dims)}}))
        values, squares = (as_fixed(np.concatenate([(a - b).ravel() for a, b in zip(now, then)])) for now, then in ((self.dense(), start.dense()), (seen, start_seen)))
        zeros = {f"d{i}": np.zeros(len(values), dtype=np.int64) for i in range(2, self.dims)}
        out.append(pd.DataFrame({"part": 2, "entry": np.arange(len(values)), "d0": values, "d1": squares, **zeros}))
        return pd.concat(out, ignore_index=True)

    def move(self, sums: dict[str, np.ndarray], seen: list[np.ndarray]) -> None:
        mean = np.stack([sums[f"d{i}"] / sums["n"] for i in range(self.dims)], axis=1) / FIXED
        for half in range(2):
            own = sums["part"] == half
            self.tables[half, sums["entry"][own]] += mean[own].astype(np.float32)
        own = np.flatnonzero(sums["part"] == 2)
        rest, at = mean[own[np.argsort(sums["entry"][own])]], 0
        for array, squares in zip(self.dense(), seen) if len(rest) else ():
            array += rest[at : at + array.size, 0].reshape(array.shape).astype(np.float32)
            squares += rest[at : at + array.size, 1].reshape(array.shape).astype(np.float32)
            at += array.size

    def fit(self, rows: DataFrame, share: float, epochs: int = 6, seed: int = 4) -> None:
        """Learns from all rows (content, digest, toxic), one round an epoch."""
        context, bits, dims = rows.sparkSession.sparkContext, self.bits, self.dims

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = np.zeros((2, 2, 1 << bits), dtype=np.int64)
            for texts, labels in _texts(batches):
                for words, y in zip(texts, labels):
                    for half, buckets in enumerate(self.buckets(words)):
                        held[int(y), half, np.unique(buckets)] += 1
            half, bucket = np.nonzero(held.any(0))
            yield pd.DataFrame({"part": half, "entry": bucket, "positive": held[1, half, bucket], "negative": held[0, half, bucket]})

        sums = summed(rows.mapInPandas(count, "part long, entry long, positive long, negative long"), "part", "entry")
        self.start_tables(sums["part"], sums["entry"], sums["positive"], sums["negative"], share)
        seen = [np.full_like(a, 1e-2) for a in self.dense()]
        for turn in range(epochs):
            shared = context.broadcast((self, seen))

            def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                start, start_seen = shared.value
                own, own_seen = copy.deepcopy((start, start_seen))
                past, rng, any_rows = np.full_like(own.tables, 1e-2), np.random.default_rng([seed, turn]), False
                for texts, labels in _texts(batches):
                    own.epoch(texts, labels, own_seen, past, rng)
                    any_rows = True
                if any_rows:
                    yield own.moves(start, own_seen, start_seen)

            schema = "part long, entry long, " + ", ".join(f"d{i} long" for i in range(dims))
            self.move(summed(rows.mapInPandas(learn, schema), "part", "entry"), seen)
            shared.unpersist()

    def calibrate(self, rows: DataFrame, least: int = 20, steps: int = 1024) -> None:
        """Thresholds by language told from the text, from all rows; a language with too few positive texts takes the one of all.

        Logits are counted in steps of 1 / steps, between -32 and 32.
        """
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for texts, labels in _texts(batches):
                logits = shared.value.logits(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
                at = np.round(np.clip(logits, -32, 32) * steps).astype(np.int64)
                yield pd.DataFrame({"tongue": [language(t) for t in texts], "at": at, "hits": labels.astype(np.int64)})

        sums = summed(rows.mapInPandas(judge, "tongue string, at long, hits long"), "tongue", "at")
        if not len(sums["n"]):
            return
        order = np.lexsort((sums["tongue"], sums["at"]))
        tongue, logits, hits, n = sums["tongue"][order], sums["at"][order] / steps, sums["hits"][order], sums["n"][order]
        self.level = _best_threshold(logits, hits, n)
        for name in sorted(set(tongue)):
            own = tongue == name
            if hits[own].sum() >= least:
                self.levels[str(name)] = _best_threshold(logits[own], hits[own], n[own])

    def scores(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        levels = np.array([self.levels.get(language(words[a:b]), self.level) for a, b in zip(places[:-1], places[1:])])
        return 1 / (1 + np.exp(-(self.logits(words, places) - levels) - np.log(CUT / (1 - CUT))))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Words of the texts and their labels, some megabytes at a time. Rows with equal digests lie side by side; one of them counts."""
    last = None
    for batch in batches:
        digests = batch["digest"].to_numpy()
        new = np.append([last], digests[:-1]) != digests
        last = digests[-1] if len(digests) else last
        batch = batch[new]
        for at, end in batches_of_texts(batch["content"].str.len().to_numpy()):
            words, places, *_ = word_hashes(batch["content"].iloc[at:end], _OTHER)
            yield [words[a:b] for a, b in zip(places[:-1], places[1:])], batch["toxic"].to_numpy()[at:end]


def _best_threshold(logits: np.ndarray, hits: np.ndarray, n: np.ndarray) -> float:
    """Middle of the widest gap among the thresholds within a hundredth of the best F1; hits of n texts have the label."""
    order = np.argsort(-logits, kind="stable")
    ranked, found = logits[order], np.cumsum(hits[order])
    f1 = 2 * found / (np.cumsum(n[order]) + max(1, hits.sum()))
    below = np.append(ranked[1:], ranked[-1] - 1)
    gap = np.where(f1 >= f1.max() - 0.01, ranked - below, -1)
    k = int(gap.argmax())
    return float((ranked[k] + below[k]) / 2)


_WORD_SETS = {name: np.sort(word_hashes(words.split(), _OTHER)[0]) for name, words in COMMON_WORDS.items()}


def language(words: np.ndarray) -> str:
    """The language most of whose common words stand in the text; other without any."""
    counts = {}
    for name, known in _WORD_SETS.items():
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        counts[name] = int((known[at] == words).sum())
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, texts_a_file: int = 4096) -> TextNet | None:
    """Fits on all labelled documents outside the held-out third; a file of about texts_a_file texts is a task's share of a round.

    Rows that share an identifier bring one text, the one with the smallest digest of its words; of texts with equal words one counts.
    Three quarters are learnt from and the rest calibrate. Without labels of both classes there is no network.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    words = F.trim(F.regexp_replace(lower_ascii(F.col("content")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("content"))
    texts = texts.join(small_side(known, 24), "doc_id").withColumn("digest", F.md5(words.cast("binary")))
    # Of equal texts the label of the largest identifier counts.
    one = texts.groupBy("doc_id", "toxic").agg(F.min("digest").alias("digest")).groupBy("digest").agg(F.max(F.struct("doc_id", "toxic")).alias("of"))
    picked = stored(one.select("digest", "of.doc_id"), "picked")
    rows = learning_set(texts.join(small_side(picked, 64), ["doc_id", "digest"]), "digest", picked.count(), texts_a_file, "labelled")
    released(picked)
    rest = F.pmod(F.xxhash64(F.lit("rest"), "digest"), F.lit(4)) == 0
    size = {(r["rest"], r["toxic"]): r["n"] for r in rows.groupBy(rest.alias("rest"), "toxic").agg(F.count_distinct("digest").alias("n")).collect()}
    if {toxic for _, toxic in size} != {0, 1}:
        released(rows)
        return None
    learnt = rows.where(~rest) if any(not r for r, _ in size) else rows
    positive, negative = (sum(n for (r, y), n in size.items() if y == toxic and not r) for toxic in (1, 0))
    net = TextNet()
    net.fit(learnt, float(np.clip(positive / max(1, positive + negative), 0.01, 0.99)))
    net.calibrate(rows.where(rest))
    released(rows)
    return net


def toxicity(docs: DataFrame, labels: DataFrame | None = None, net: TextNet | None = None, **training) -> DataFrame:
    """Per row of docs: row (all its columns as a struct), doc_id, held_out, score, predicted.

    Empty or null texts have a score like others, from no words. Without a network (no labels of both classes) every
    score is 0.
    """
    if net is None and labels is not None:
        net = train(docs, labels, **training)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # tables of a fixed size

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for part in parts:
            out = []
            for at, end in batches_of_texts(part.str.len().to_numpy(), 2 << 20):
                if model is None:
                    out.append(np.zeros(end - at))
                else:
                    words, places, *_ = word_hashes(part.iloc[at:end], _OTHER)
                    out.append(model.scores(words, places))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    scored = F.pandas_udf(score, "double")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("content"))
    out = rows.select("row", "doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("content").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
