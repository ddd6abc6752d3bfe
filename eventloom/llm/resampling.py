"""Importance resampling towards a target distribution.

Features of a text are its runs of 1 to max_n words; each falls into one of a fixed number of buckets by crc32. Both
tables are counted whole, a bucket's gain is the rounded logarithm of the ratio of its smoothed shares, and a document's
weight is the sum of its features' gains, read from an array by bucket. Weight plus hash-seeded Gumbel noise is the score;
the documents with the highest scores are drawn, which samples without replacement in proportion to exp(weight).

The cutoff is found by a quantile sketch: its two values around the wanted rank make a bracket, exact counts of what lies
above and inside validate it or widen it, and only the rows of the bracket are sorted to find the last row drawn. The
drawn rows are range-partitioned and numbered by partition, so no task holds them all; ties of score and identifier are
split by the number of the stored row.

Null and empty texts have no features, weight 0 and are never drawn while least_words is 1 or more. A missing identifier
is hashed as an empty text and comes after all others in ties. Repeated rows are rows of their own: each is scored, and
equal ones follow each other in rank. An empty target table leaves all shares to the smoothing; an empty table of
documents gives no rows. Columns other than the two that are named play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.common import stored, text_or_empty

# A-Z to a-z; all other bytes below 0x80 but digits and a-z separate words.
TABLE = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
PIECE = 1 << 20
SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of about PIECE bytes."""
    at = 0
    while at < len(data):
        cut = SEPARATOR.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end].translate(TABLE).split()
        at = end


def features(data: bytes, max_n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Piece by piece, its number of words and the buckets of all runs of 1 to max_n words that end in it."""
    last: list[bytes] = []
    for words in pieces(data):
        out = [np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))]
        for n in range(2, max_n + 1):
            line = [*last[len(last) - min(len(last), n - 1) :], *words]
            runs = [b" ".join(line[i : i + n]) for i in range(len(line) - n + 1)]
            out.append(np.fromiter(map(crc32, runs), dtype=np.uint32, count=len(runs)))
        last = [*last, *words][-(max_n - 1) :] if max_n > 1 else []
        yield len(words), np.concatenate(out) % np.uint32(buckets)


def bucket_counts(table: DataFrame, max_n: int = 1, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """(bucket, n) over all texts; each task sends one row per bucket at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch["content"]:
                for _, found in features(text.encode(), max_n, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int64), "n": total[at]})

    counted = table.select(text_or_empty(text_col).alias("content")).mapInPandas(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counts.collect():  # one row per bucket, a parameter
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share over the smoothed source share, per bucket."""
    buckets = len(source)
    s_all, t_all = float(source.sum() + buckets), float(target.sum() + buckets)
    ratio = ((float(t) + 1.0) * s_all / ((float(s) + 1.0) * t_all) for s, t in zip(source, target))
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratio], dtype=np.int64)


def noise(seed: int, doc_id: str | None) -> int:
    """Gumbel noise of an identifier in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{doc_id if isinstance(doc_id, str) else ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, max_n: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: identifier, n_words, n_features, weight, score."""
    buckets = len(gain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["id"], batch["content"]):
                words = count = weight = 0
                for n, found in features(text.encode(), max_n, buckets):
                    words, count, weight = words + n, count + len(found), weight + int(gain[found].sum())
                rows.append((doc_id, words, count, weight, weight + noise(seed, doc_id)))
            yield pd.DataFrame(rows, columns=["id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("content"))
    out = rows.mapInPandas(run, "id string, n_words long, n_features long, weight long, score long")
    return out.select(F.col("id").cast(kind).alias("id"), "n_words", "n_features", "weight", "score")


def order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """Numbers rows 1, 2, ... in order(): range partitions are sorted, numbered each for itself and offset by the sizes before."""
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = rows.repartitionByRange(int(parts), *order()).sortWithinPartitions(*order())
    placed = stored(spread.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())  # one row per partition
    before, total = {}, 0
    for p, n in sizes:
        before[p] = total
        total += n
    offsets = rows.sparkSession.createDataFrame([(int(p), int(n)) for p, n in before.items()], "part long, before long")
    local = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn(out, F.col("before") + local + 1).drop("part", "before", "at")


def cutoff(rows: DataFrame, wanted: int, total: int, accuracy: int = 10_000) -> tuple | None:
    """(score, id, row) of the wanted-th row in order(), 1 <= wanted <= total."""
    width = 2.0 / accuracy
    place = 1.0 - wanted / total
    while True:
        ends = [max(0.0, place - width), min(1.0, place + width)]
        low, high = rows.agg(F.percentile_approx("score", ends, accuracy)).first()[0]
        low = None if ends[0] == 0.0 else low
        high = None if ends[1] == 1.0 else high
        over = F.lit(False) if high is None else F.col("score") > high
        under = F.lit(False) if low is None else F.col("score") < low
        above, below = rows.agg(F.count_if(over), F.count_if(under)).first()
        if above < wanted <= total - below:
            break
        width *= 8
    last = numbered(rows.where(~over & ~under).select("score", "id", "row"), "place").where(F.col("place") == wanted - above)
    return tuple(last.select("score", "id", "row").first())


def _drawn(last: tuple) -> Column:
    """Whether a row comes no later than the last one in order()."""
    score, doc_id, row = last
    ids = F.col("id")
    same = ids.isNull() if doc_id is None else F.coalesce(ids == F.lit(doc_id), F.lit(False))
    before = ids.isNotNull() if doc_id is None else F.coalesce(ids < F.lit(doc_id), F.lit(False))
    return (F.col("score") > score) | ((F.col("score") == score) & (before | (same & (F.col("row") <= row))))


def resample(
    docs: DataFrame, target: DataFrame, *, max_n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20,
    id_col: str = "doc_id", text_col: str = "text", accuracy: int = 10_000,
) -> DataFrame:
    """A row per row of docs: identifier, n_features, weight, score and rank, null where the row is not drawn.

    Of the rows with at least least_words words, floor(percent * rows / 100) are drawn.
    """
    gain = gains(_array(bucket_counts(docs, max_n, buckets, text_col), buckets), _array(bucket_counts(target, max_n, buckets, text_col), buckets))
    every = scored(docs, gain, max_n, seed, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    every = stored(every, "scored")  # narrow rows; fixes the row numbers
    able = F.col("n_words") >= least_words
    total = every.where(able).count()
    wanted = percent * total // 100
    result = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    if not wanted:
        return every.select(*result, F.lit(None).cast("long").alias("rank"))
    rows = every.where(able)
    drawn = _drawn(cutoff(rows, wanted, total, accuracy))
    ranked = numbered(rows.where(drawn), "rank").select(*result, "rank")
    return ranked.unionByName(every.where(~(able & drawn)).select(*result, F.lit(None).cast("long").alias("rank")))
