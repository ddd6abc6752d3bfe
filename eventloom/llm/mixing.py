"""Mixing sources to target weights.

Words are added up per source, targets follow from weights, and each document is taken floor(rate) times plus once more
with a probability equal to the rate's fraction. That last choice is a Bernoulli draw seeded by a hash of the document's
identifier. Several seeds are tried per source at once, and the one whose total comes nearest to the target is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.llm.common import small_side, stored, text_or_empty

#: Fixed value: a word of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEEDS = 16


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(doc_id: Column, seed: Column | int) -> Column:
    """A number in [0, 1) from 32 bits of a digest."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    digest = F.md5(F.concat(seed, F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Sizes per source (source, source_size) to source, source_size, target.

    Sources, by code point with null last, take the weights in turn and share total_share of all sizes; no target passes
    most times its source's size, and what is over goes to the others by weight. Sources that reach their limit are those
    with the least limit per weight, so one ordered pass with running sums finds them. The table has one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("w")).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = F.lit(float(total_share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    walked = ranked.select("*", rest.alias("rest"), left.alias("left"))
    walked = walked.withColumn("open", F.col("rest") / F.col("left") * F.col("w") <= F.col("limit"))
    rate = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("w"), F.col("rest"), F.col("left")))).over(everything)
    level = rate["rest"] / rate["left"]
    return walked.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("w") * level, F.col("limit"))).alias("target"))


def mixing_plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, total_share: float = 1.5, most: float = 2.0, seeds: int = SEEDS) -> DataFrame:
    """Rows (doc_id, source, size) to one row per source: source, source_size, target, rate, seed."""
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, most)
    aims = stored(aims.withColumn("rate", F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))), "targets")
    part = F.col("rate") - F.floor("rate")
    # One pass adds up what every seed would take; partial sums leave each task as one row per source.
    tried = with_source(sized, aims).groupBy("source").agg(
        F.first("target").alias("target"),
        F.sum(F.floor("rate") * F.col("size")).alias("base"),
        *[F.sum(F.when(draw(F.col("doc_id"), s) < part, F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(seeds)],
    )
    best = F.array_min(F.array(*[F.struct(F.abs(F.col("base") + F.col(f"s{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)]))
    chosen = tried.select("source", best["seed"].alias("seed"))
    return stored(with_source(aims, chosen), "mixing-plan")


def with_source(table: DataFrame, by_source: DataFrame) -> DataFrame:
    """Adds the columns of a table with one row per source; null meets null."""
    other = small_side(by_source.withColumnRenamed("source", "__of"), 256)
    return table.join(other, table["source"].eqNullSafe(other["__of"]), "left").drop("__of")


def n_copies() -> Column:
    part = F.col("rate") - F.floor("rate")
    return (F.floor("rate") + (draw(F.col("doc_id"), F.col("seed")) < part).cast("int")).cast("int")


def sizes_of(docs: DataFrame) -> DataFrame:
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(text_or_empty()).alias("size")), "sizes")


def copies(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    Null text has size 0; null is a source of its own. A source without words takes nothing. Rows that repeat an
    identifier share its draw. Reruns give the same copies. An empty table gives an empty result.
    """
    sized = sizes_of(docs)
    rated = with_source(sized, mixing_plan(sized, **settings))
    return rated.select("doc_id", "source", "size", "source_size", "target", n_copies().alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The documents with all their columns, each as often as it is taken; copies of a row are equal."""
    plan = mixing_plan(sizes_of(docs), **settings).select("source", "rate", "seed")
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = with_source(row, plan).withColumn("times", n_copies()).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
