"""Benchmark decontamination by spaced-seed hashing.

A mask is laid on every word position; the words under its ones are hashed, the others may differ. Hashes of benchmark
items and of documents are joined. Each hit names a document, an item and how one lies on the other; there the words are
compared one by one, and the longest stretch in which enough of them are equal is the overlap.

Document hashes first pass a bit table of a fixed size with the benchmark's hashes, so that few leave their task; it lets
every true hit through, however large the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import _OTHER, batches_of_texts, mixed, small_by_bytes, small_side, stored, text_or_empty, word_hashes

# Fixed values, found by exhaustive search: every stretch of 13 words or more that starts and ends with an equal word and has
# 80 % equal ones holds one of the masks, wherever the others are. A test goes through all stretches.
MASKS = ("11101011", "11001000111", "1111011", "111111")
LEAST_WORDS = 5
TABLE_BITS = 23
#: For whole items of so many words: what hits the stretches that the masks miss.
SHORT_MASKS = {
    **{n: tuple("1" * j + "0" + "1" * (n - 1 - j) for j in range(1, n - 1)) for n in (5, 6, 7)},
    8: ("1101111",), 10: ("110110011", "11001111", "1011111"), 11: ("11110011",),
}


def _masks(n_words: int) -> tuple[str, ...]:
    """The masks of an item of so many words."""
    return MASKS + SHORT_MASKS.get(n_words, ())


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash under the mask at each position where it fits."""
    n = len(words) - len(mask) + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        for j, on in enumerate(mask):
            if on == "1":
                out = mixed(out ^ words[j : j + n], 5)
        out = mixed(out, int(mask, 2) % 9973)
    return out


def _probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.uint64((1 << TABLE_BITS) - 1)
    return hashes & keep, (hashes >> np.uint64(32)) & keep


def _item_words(benchmark: DataFrame) -> DataFrame:
    """item_id, words (bytes of the hashes), n_words of items with at least LEAST_WORDS words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, places, *_ = word_hashes(batch["content"], _OTHER)
            rows = [(i, words[a:b].tobytes(), b - a) for i, a, b in zip(batch["item_id"], places[:-1], places[1:]) if b - a >= LEAST_WORDS]
            yield pd.DataFrame(rows, columns=["item_id", "words", "n_words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("content")).where("item_id is not null")
    return rows.mapInPandas(run, "item_id long, words binary, n_words long")


def longest_overlap(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch [start, end) that starts and ends with an equal word and has at least this share of them."""
    if not equal.any():
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(equal - share)])
    # A stretch (i, j) counts when sums[j] >= sums[i]: the best start for j is the first place whose sum is no larger.
    lows = np.minimum.accumulate(sums)
    starts = np.searchsorted(-lows, -(sums[1:] + 1e-9), side="left")
    # Unequal words at either end are left out, which only raises the share.
    places = np.where(equal, np.arange(len(equal)), len(equal))
    following = np.append(np.minimum.accumulate(places[::-1])[::-1], len(equal))
    lengths = np.where(equal, np.arange(1, len(sums)) - following[starts], 0)
    end = int(lengths.argmax()) + 1
    return int(following[starts[end - 1]]), end


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8) -> DataFrame:
    """Overlaps of documents with items: doc_id, item_id, start_word, item_start, n_words, equal_words.

    Words are runs of letters and digits, lower-cased in A-Z. An overlap has at least ``least`` words (or all of a shorter
    item), of which ``share`` are equal at their places; per document and item the longest one is given. Items with fewer
    than LEAST_WORDS words are phrases rather than passages and are left out. Documents or items without text or
    identifier have no overlaps; the masks are whole for these settings or stricter ones; rows that share an identifier are one document. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = stored(_item_words(benchmark), "items")
    # At most as many numbers as SHORT_MASKS has.
    short = sorted(r[0] for r in items.where(F.col("n_words").isin(list(SHORT_MASKS))).select("n_words").distinct().collect())
    masks = list(dict.fromkeys([*MASKS, *(m for n in short for m in SHORT_MASKS[n])]))

    def item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, raw in zip(batch["item_id"], batch["words"]):
                words = np.frombuffer(raw, dtype=np.uint64)
                parts = [seed_hashes(words, m) for m in _masks(len(words))]
                at = np.concatenate([np.arange(len(p)) for p in parts])
                yield pd.DataFrame({"h": np.concatenate(parts).view(np.int64), "item_id": item, "item_at": at})

    seeds = stored(items.mapInPandas(item_seeds, "h long, item_id long, item_at long").distinct(), "item-seeds")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << TABLE_BITS, dtype=bool)
        for batch in batches:
            for p in _probes(batch["h"].to_numpy().view(np.uint64)):
                table[p.astype(np.int64)] = True
        yield pd.DataFrame({"bits": [np.packbits(table).tobytes()]})

    bits = np.zeros(1 << (TABLE_BITS - 3), dtype=np.uint8)
    for part in seeds.select("h").coalesce(8).mapInPandas(fill, "bits binary").toLocalIterator():  # at most eight tables of a fixed size
        bits |= np.frombuffer(part[0], dtype=np.uint8)
    shared = spark.sparkContext.broadcast(bits.tobytes())

    def doc_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8)).view(bool)
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for lo, hi in batches_of_texts(batch["content"].str.len().to_numpy(), 2 << 20):
                words, places, *_ = word_hashes(batch["content"].iloc[lo:hi], _OTHER)
                for mask in masks:
                    hashes = seed_hashes(words, mask)
                    one, two = _probes(hashes)
                    at = np.flatnonzero(table[one.astype(np.int64)])
                    at = at[table[two[at].astype(np.int64)]]
                    if len(at):
                        doc = np.searchsorted(places, at, side="right") - 1
                        whole = at + len(mask) <= places[doc + 1]  # not across two documents
                        at, doc = at[whole], doc[whole]
                        yield pd.DataFrame({"h": hashes[at].view(np.int64), "doc_id": ids[lo:hi][doc], "at": at - places[doc]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("content")).where("doc_id is not null")
    hits = rows.mapInPandas(doc_seeds, "h long, doc_id long, at long")
    placed = hits.join(small_side(seeds, 32), "h").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("lies"))
    # A row per document and item, so that an item's words come once however many hits it has.
    pairs = placed.groupBy("doc_id", "item_id").agg(F.collect_set("lies").alias("lies"))
    with_words = pairs.join(small_by_bytes(items, F.length("words")), "item_id")
    by_doc = stored(with_words.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("item_id", "lies", "words")).alias("hits")), "hits")
    hit_bytes = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + F.length(h["words"]) + 8 * F.size(h["lies"]) + 32)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            words, places, *_ = word_hashes(batch["content"], _OTHER)
            for doc, hits, a, b in zip(batch["doc_id"], batch["hits"], places[:-1], places[1:]):
                own = words[a:b]
                for item_id, lies, item in ((hit["item_id"], int(at), np.frombuffer(hit["words"], dtype=np.uint64)) for hit in hits for at in hit["lies"]):
                    first, last = max(0, -lies), min(len(item), len(own) - lies)
                    if last <= first:
                        continue
                    equal = own[first + lies : last + lies] == item[first:last]
                    s, e = longest_overlap(equal, share)
                    if e - s >= min(least, len(item)):
                        found.append((doc, item_id, first + lies + s, first + s, e - s, int(equal[s:e].sum())))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "start_word", "item_start", "n_words", "equal_words"])

    texts = rows.join(small_by_bytes(by_doc, hit_bytes), rows["doc_id"] == by_doc["of"]).select("doc_id", "content", "hits")
    verified = texts.mapInPandas(verify, "doc_id long, item_id long, start_word long, item_start long, n_words long, equal_words long")
    best = F.max(F.struct("n_words", "equal_words", (-F.col("start_word")).alias("back"), "item_start"))
    out = verified.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", (-F.col("b.back")).alias("start_word"), "b.item_start", "b.n_words", "b.equal_words")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents with the same columns that overlap no item. Documents without identifier stay."""
    gone = stored(contaminated(docs, benchmark, **settings).select(F.col("doc_id").alias("__gone")).distinct(), "contaminated")
    return docs.join(small_side(gone, 8), docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
