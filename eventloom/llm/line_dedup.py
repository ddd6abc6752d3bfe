"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line hashes with the number of documents and the largest document that hold each line, dealt into
buckets by hash and sorted within each bucket. A new batch of lines is merge-anti-joined with every run, bucket by bucket
and without a shuffle of the runs: what is left are its new lines, which become a run of their own, so that every line is
in exactly one run. The batch's known lines become a table of updates beside the runs. When a level holds ``fan_in`` runs
(or tables of updates), they are merged into one of the next level.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.llm.common import SPACES, lower_ascii, released, shuffles_removed, small_side, stored, text_or_empty, work_folder


def line_key(line: Column) -> Column:
    """White space off both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def line_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


#: Rows of one bucket of a run.
BUCKET_ROWS = 500_000


class LineRuns:
    """Levels of runs and of updates (key, n_docs, last_doc). Tables lie in the shared folder; equal settings give equal runs."""

    def __init__(self, spark: SparkSession, fan_in: int = 2, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.updates: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows.select("key", "n_docs", "last_doc")
        with shuffles_removed(self.spark):
            rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", work_folder(self.spark, name)).format("parquet").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            released(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")

    def add(self, lines: DataFrame) -> None:
        """Adds a batch (key, doc_id). A document's lines must all be in one batch; rows may repeat."""
        own = lines.distinct().groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        batch = self._write(own.repartition(self.buckets, "key"))
        names = [n for level in self.levels for n in level]
        if not names:
            self._push(self.levels, batch, 0)
            return
        # All tables are dealt alike, so neither these joins nor what they write needs a shuffle.
        new = self.spark.table(batch)
        for name in names:
            new = new.join(self.spark.table(name).select("key"), "key", "left_anti")
        fresh = self._write(new)
        known = self._write(self.spark.table(batch).join(self.spark.table(fresh).select("key"), "key", "left_anti"))
        self._drop([batch])
        self._push(self.levels, fresh, 0)
        self._push(self.updates, known, 0)

    def _push(self, levels: list[list[str]], name: str, level: int) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(name)
        if len(levels[level]) >= self.fan_in:
            full, levels[level] = levels[level], []
            merged = self._write(self._merged(full, levels is self.updates))
            self._drop(full)
            self._push(levels, merged, level + 1)

    def _merged(self, names: list[str], updates: bool) -> DataFrame:
        """Runs share no line; updates of one line add up."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            a, b = out.alias("a"), self.spark.table(name).alias("b")
            both = F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))
            out = a.join(b, F.col("a.key") == F.col("b.key"), "full_outer").select(
                F.coalesce("a.key", "b.key").alias("key"),
                (both if updates else F.coalesce("a.n_docs", "b.n_docs")).alias("n_docs"),
                (F.greatest if updates else F.coalesce)("a.last_doc", "b.last_doc").alias("last_doc"),
            )
        return out

    def whole(self) -> DataFrame:
        """Every line of all runs with its updates: key, n_docs, last_doc. Each run is merge-joined with the updates; none is shuffled."""
        updates = [n for level in self.updates for n in level]
        found = []
        for name in (n for level in self.levels for n in level):
            rows = self.spark.table(name)
            for update in updates:
                known = self.spark.table(update).select("key", F.col("n_docs").alias("more"), F.col("last_doc").alias("later"))
                n_docs = F.col("n_docs") + F.coalesce("more", F.lit(0))
                rows = rows.join(known, "key", "left").select("key", n_docs.alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))
            found.append(rows)
        return reduce(DataFrame.union, found)

    def close(self) -> None:
        """Takes the tables out of the catalog; frames read from them must be stored before."""
        self._drop([n for level in self.levels + self.updates for n in level])
        self.levels, self.updates = [], []


def drop_repeated_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 3) -> DataFrame:
    """Per row of docs: row (all its columns as a struct), doc_id, kept_text, n_lines, n_dropped.

    A line whose key has at least min_chars code points and stands in at least min_docs documents stays only in the
    document with the largest identifier, there as often as it stands. Null or empty text is one empty line. Rows that
    share an identifier are one document; rows without one keep all lines and count nowhere. An empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("content")
    )
    lines = rows.where("doc_id is not null").select("doc_id", F.explode(F.split("content", "\n", -1)).alias("line"))
    keys = lines.select("doc_id", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    keys = keys.select(line_hash(F.col("key")).alias("key"), "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    keys = stored(keys, "lines", "batch")

    runs = LineRuns(spark, buckets=1 + keys.count() // BUCKET_ROWS)
    for batch in range(batches):
        runs.add(keys.where(F.col("batch") == batch).select("key", "doc_id"))
    repeated = stored(runs.whole().where(F.col("n_docs") >= min_docs).select("key", "last_doc"), "repeated-lines")
    runs.close()

    hits = keys.select("key", "doc_id").join(small_side(repeated, 32), "key").where("doc_id <> last_doc")
    by_doc = hits.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("key").alias("gone"))
    joined = rows.join(by_doc, F.col("doc_id") == F.col("of"), "left")
    split = F.split("content", "\n", -1)
    kept = F.filter(split, lambda l: ~F.array_contains(F.col("gone"), line_hash(line_key(l))))
    out = joined.select("row", "doc_id", split.alias("lines"), F.when(F.col("gone").isNull(), split).otherwise(kept).alias("left"))
    return out.select(
        "row", "doc_id", F.array_join("left", "\n").alias("kept_text"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
    )


def without_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """The documents with the same columns: text without its repeated lines (null stays null), n_chars counted anew if there."""
    out = drop_repeated_lines(docs, **settings)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    made = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
