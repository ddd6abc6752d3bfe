"""Shared helpers: stored intermediate tables, size-checked broadcasts, word hashing in numpy, components of a link graph."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from eventloom.session import checkpoint_dir

# White space of the contracts, [\x20\x09-\x0D], and the letters that are lower-cased.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most bytes of a table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder that the cluster names."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: With this setting Spark removes a job's shuffle files when the job ends, not when the driver next collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if was is None else spark.conf.set(SHUFFLE_CLEANUP, was)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, so that lineage ends at files every executor sees.

    Nothing reads the shuffles behind it any more; they go with the write.
    """
    path = work_folder(df.sparkSession, name)
    schema = df.schema
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Empties the folders of stored tables once all that reads them is stored itself; a later read fails."""
    for table in tables:
        for path in {re.match(r".*/[^/]+-[0-9a-f]{32}(?=/)", f)[0] for f in table.inputFiles()}:
            table.sparkSession.range(0).write.mode("overwrite").parquet(path)


def stored_counting(df: DataFrame, name: str, condition: Column | None = None) -> tuple[DataFrame, int]:
    """As stored, and the number of its rows (for which the condition holds), counted while they are written."""
    counted = Observation()
    kept = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return stored(df.observe(counted, kept.alias("n")), name), counted.get["n"]


def small_side(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Marks df for a broadcast if its rows, counted, stay within BROADCAST_BYTES; else it goes through a shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def small_by_bytes(df: DataFrame, row_bytes: Column) -> DataFrame:
    """As small_side, by the sum of row_bytes and of 64 bytes a row, for rows of unequal size."""
    size = df.agg(F.sum(row_bytes.cast("long") + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


# Learning in rounds --------------------------------------------------------------------------------------------------

#: Moves of parameters are summed as whole multiples of 1 / FIXED, so that their sum does not depend on the order.
FIXED = 1 << 32


def as_fixed(moves: np.ndarray) -> np.ndarray:
    return np.round(moves.astype(np.float64) * FIXED).astype(np.int64)


def learning_set(rows: DataFrame, key: str, n_rows: int, rows_a_file: int, name: str) -> DataFrame:
    """Stored in files of about so many rows, each in the order of the key's hash; rows with equal keys lie side by side."""
    files = max(1, -(-n_rows // rows_a_file))
    return stored(rows.repartition(files, key).sortWithinPartitions(F.xxhash64(key), key), name)


def summed(moves: DataFrame, *keys: str) -> dict[str, np.ndarray]:
    """Sums of all other columns by the keys and n, the number of rows summed, as arrays. There are at most as many keys as
    a network has parameters."""
    values = [c for c in moves.columns if c not in keys]
    table = moves.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values], F.count(F.lit(1)).alias("n")).toArrow()
    return {c: table[c].to_numpy() for c in table.column_names}


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


# Word hashing -------------------------------------------------------------------------------------------------------

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply) over an array; salt may be an array of as many."""
    if isinstance(salt, np.ndarray):
        x = x + (salt.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    else:
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x2545F4914F6CDD1D
_SLICE = 1 << 20
_BYTE = mixed(np.arange(256, dtype=np.uint64), 7)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For words of letters and digits only: every other ASCII byte separates.
_OTHER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _SLICE)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _slices(data: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about _SLICE bytes that end at white space, so that no word is cut."""
    at = 0
    while at < len(data):
        end = min(at + _SLICE, len(data))
        while end < len(data):
            gaps = np.flatnonzero(space[data[end : end + _SLICE]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + _SLICE, len(data))
        yield at, end
        at = end


def word_hashes(texts: Iterable[str | None], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes of all words of the texts, lower-cased in A-Z.

    Returns hashes, the place of each text's first word (one more than texts), each word's first byte and the byte
    after it in the joined UTF-8 text, and that text. Texts are joined by line feeds.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(parts) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    hashes, firsts, lasts = [], [], []
    for at, end in _slices(data, space):
        part = data[at:end]
        gap = space[part]
        edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(first):
            continue
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        hashes.append(mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        firsts.append(first + at)
        lasts.append(last + at)
    none = np.zeros(0, dtype=np.int64)
    first = np.concatenate(firsts) if firsts else none
    last = np.concatenate(lasts) if lasts else none
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return (np.concatenate(hashes) if hashes else none.astype(np.uint64)), np.searchsorted(first, starts), first, last, joined


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k neighbouring word hashes; fewer words make one shingle of all, none make none."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for j in range(size):
        out = mixed(out ^ words[j : n - size + 1 + j], 3)
    return mixed(out, size)


def batches_of_texts(sizes: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have about limit bytes (one text at least)."""
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield at, i
            at, held = i, 0
        held += int(size)
    if at < len(sizes):
        yield at, len(sizes)


# Components ---------------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """Links (x, y) to (node, root): the smallest node that is reachable, for every node that has a link.

    Each round takes the smallest root in the neighbourhood and then the root's root, so that rounds grow with the
    logarithm of the longest chain in practice. Every round is written to the shared folder.
    """
    both = stored(links.select("x", "y").union(links.select("y", "x")).where("x <> y").distinct(), "links")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("root")), "labels")
    moved = 1
    while moved:
        seen = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("root").alias("least"))
        near = labels.join(seen, labels["node"] == seen["x"]).select("node", F.col("root").alias("was"), F.least("root", "least").alias("root"))
        roots = labels.select(F.col("node").alias("at"), F.col("root").alias("up"))
        root = F.least("root", "up")
        turned = near.join(roots, near["root"] == roots["at"], "left").select("node", root.alias("root"), (F.col("was") != root).alias("moved"))
        labels, moved = stored_counting(turned, "labels", F.col("moved"))
    return labels.select("node", "root")
