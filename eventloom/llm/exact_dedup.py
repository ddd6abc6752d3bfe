"""Exact deduplication by content sort.

Rows are dealt by range over (first bytes, hash, salt) with splitters that Spark samples from those short keys, sorted
within each range by the whole text, and each row is compared in full with its neighbour. Equal texts are adjacent, so a
run of equal neighbours is a group; the row with the largest (or smallest) identifier stays.

A text that makes up more than a small share of all rows is spread by a salt drawn from the identifier. There can be no
more such texts than rows divided by that share, which bounds the broadcast list. The runs of one spread text are then
stitched by their digests: one short row per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from eventloom.llm.common import stored, text_or_empty

#: A text is hot when it has more than 1 / (HOT_SHARE * partitions) of all rows: at most HOT_SHARE * partitions texts.
HOT_SHARE = 4
PREFIX = 32


def exact_duplicates(docs: DataFrame, keep: str = "max", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Rows without an identifier belong to their group but stay only if all of it has none
    (keep_id is then null). Of rows that repeat text and identifier, one stays. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("content"))
    rows = rows.withColumn("h", F.xxhash64("content"))
    counts = rows.groupBy("h").count()
    total = docs.select(F.count(F.lit(1))).first()[0]
    share = max(1, total // (HOT_SHARE * parts))
    hot = stored(counts.where(F.col("count") > share).select("h", F.ceil(F.col("count") / share).alias("salts")), "hot-texts")

    # At most HOT_SHARE * parts rows of 16 bytes, by the choice of share.
    spread = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.coalesce(F.col("salts"), F.lit(1)))
    keyed = rows.join(F.broadcast(hot), "h", "left").select(
        "doc_id", "content", "h", F.substring(F.encode("content", "UTF-8"), 1, PREFIX).alias("head"), spread.alias("salt"),
        F.col("salts").isNotNull().alias("is_hot"),
    )
    order = F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()
    ranged = keyed.repartitionByRange(parts, "head", "h", "salt")
    # The range partitioning is kept by windows over its own keys: one shuffle, one sort.
    near = Window.partitionBy("head", "h", "salt").orderBy("content", order)
    starts = ranged.withColumn("starts", ~F.lag("content").over(near).eqNullSafe(F.col("content")))
    runs = starts.select(
        "doc_id", "h", "salt", "head", "is_hot", F.sum(F.col("starts").cast("int")).over(near).alias("run"),
        F.row_number().over(near).alias("at"), F.sha2("content", 256).alias("text_sha256"),
    )
    run = Window.partitionBy("head", "h", "salt", "run")
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    out = runs.select(
        "doc_id", "h", "salt", "is_hot", "text_sha256", best.over(run).alias("keep_id"), F.count(F.lit(1)).over(run).alias("group_size"),
        (F.col("at") == F.min("at").over(run)).alias("kept"),
    )
    out = stored(out, "runs")

    # Stitching: one row per salt of a hot text. The rows that lead their runs stand for them.
    lead = out.where("is_hot and kept")
    best_lead = F.max("keep_id") if keep == "max" else F.min("keep_id")
    whole = lead.groupBy("h", "text_sha256").agg(best_lead.alias("all_id"), F.sum("group_size").alias("all_size"), F.max_by("salt", F.struct(
        F.col("keep_id").isNotNull(), F.col("keep_id") if keep == "max" else -F.col("keep_id"), "salt")).alias("all_salt"))
    joined = out.join(F.broadcast(whole), ["h", "text_sha256"], "left")
    return joined.select(
        "doc_id", F.when(F.col("all_size").isNull(), F.col("keep_id")).otherwise(F.col("all_id")).alias("keep_id"),
        F.coalesce("all_size", "group_size").cast("long").alias("group_size"),
        (F.col("kept") & (F.col("all_salt").isNull() | (F.col("salt") == F.col("all_salt")))).alias("kept"), "text_sha256",
    )
