"""Temporal co-occurrence: a trigger with some P and some N so that all three lie within
the window, in any order.

Only a few facts matter for a trigger: the nearest P and N on either side and the first of
each inside its trailing window. Time is cut into slices much shorter than the window.

* Facts of a slice that holds no cut point (a trigger's time or its window's start) matter
  only as the slice's first and last, which are aggregated on the map side.
* Facts of the other slices are walked once in order together with the cut points, forwards
  for what came before and backwards for what comes after.
* Nothing beyond the window can pair, so slice extremes are handed only to neighbours: blocks
  of slices as long as the window see themselves and the blocks next to them.

Facts are never paired with each other, no slice sees all slices, and nothing is counted
while the plan is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .context import slice_of, window_micros

FIRST_SEQ = -(1 << 63)
SLICES = 32  # per window, unless the caller gives a length
KINDS = ("p", "n")


def _point(us: Column, seq: Column) -> Column:
    return F.struct(us.alias("us"), seq.alias("seq"))


def co_occurrence(
    events: DataFrame,
    window_secs: float,
    *,
    trigger: Column,
    first: Column,
    second: Column,
    by: Sequence[str] = (),
    keep: Sequence[str] = (),
    slice_secs: float | None = None,
) -> DataFrame:
    """Triggers that have a ``first`` and a ``second`` event within the window.

    Output: ``us``, ``seq``, the kept columns of the trigger, and the pair chosen as evidence
    as structs ``first_event`` and ``second_event`` (``us``, ``seq`` and the kept columns): the
    earliest of each in the trailing window of the trigger when both exist, else the valid
    pair with the smallest span, then the nearest first event, then the nearest second event.
    """
    window_us = window_micros(window_secs)
    slice_us = max(1, window_micros(slice_secs) if slice_secs is not None else window_us // SLICES)
    us, seq = F.col("us"), F.col("seq")
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(1).alias("_"))
    keys = list(by) or ["_all"]
    events = events if by else events.withColumn("_all", F.lit(0))
    place = [*keys, "_slice"]

    facts = events.where(first | second).select(
        *keys,
        slice_of(us, slice_us).alias("_slice"),
        F.explode(F.array(F.when(first, F.lit("p")), F.when(second, F.lit("n")))).alias("kind"),
        F.struct(_point(us, seq).alias("at"), kept.alias("kept")).alias("fact"),
    ).where("kind is not null")
    cuts = (
        events.where(trigger)
        .select(
            *keys,
            us.alias("t_us"),
            seq.alias("t_seq"),
            kept.alias("t_kept"),
            F.explode(
                F.array(_point(us, seq), _point(us - F.lit(window_us), F.lit(FIRST_SEQ)))
            ).alias("at"),
        )
        .withColumn("_slice", slice_of(F.col("at.us"), slice_us))
    )

    def of_kind(kind):
        return F.when(F.col("kind") == kind, F.col("fact"))

    # Inside the slices that hold a cut point.
    near = facts.join(cuts.select(*place).distinct(), place, "left_semi")
    both = near.select(
        *place, F.col("fact.at").alias("at"), *[of_kind(k).alias(k) for k in KINDS]
    ).unionByName(cuts.select(*place, "at", "t_us", "t_seq", "t_kept"), allowMissingColumns=True)
    is_cut = F.col("t_us").isNotNull()
    running = [Window.unboundedPreceding, Window.currentRow]
    forwards = Window.partitionBy(*place).orderBy("at", is_cut).rowsBetween(*running)
    backwards = Window.partitionBy(*place).orderBy(F.col("at").desc(), is_cut).rowsBetween(*running)
    seen = both.select(
        *place,
        "at",
        "t_us",
        "t_seq",
        "t_kept",
        *[F.last(k, ignorenulls=True).over(forwards).alias(f"{k}_before") for k in KINDS],
        *[F.last(k, ignorenulls=True).over(backwards).alias(f"{k}_after") for k in KINDS],
    ).where(is_cut)

    # Beyond the slice: first and last of each slice, seen from the blocks within the window.
    extremes = facts.groupBy(*place).agg(
        *[F.max(of_kind(k)).alias(f"{k}_max") for k in KINDS],
        *[F.min(of_kind(k)).alias(f"{k}_min") for k in KINDS],
    )
    cut_slices = cuts.select(*place).distinct().withColumn("_asks", F.lit(True))
    per_block = -(-window_us // slice_us) + 1
    block = F.floor(F.col("_slice") / F.lit(per_block)).cast("bigint")
    shown = extremes.withColumn("_block", F.explode(F.array(block - 1, block, block + 1)))
    shown = shown.unionByName(cut_slices.withColumn("_block", block), allowMissingColumns=True)
    steps = Window.partitionBy(*keys, "_block")
    earlier = steps.orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    later = steps.orderBy(F.col("_slice").desc()).rangeBetween(Window.unboundedPreceding, -1)
    beyond = (
        shown.select(
            *place,
            "_asks",
            *[F.max(f"{k}_max").over(earlier).alias(f"{k}_earlier") for k in KINDS],
            *[F.min(f"{k}_min").over(later).alias(f"{k}_later") for k in KINDS],
        )
        .where("_asks")
        .drop("_asks")
    )
    looked_up = seen.join(beyond, place, "left")

    is_now = F.col("at.seq") == F.col("t_seq")
    t_at = _point(F.col("t_us"), F.col("t_seq"))

    def nearest(kind, side, other):
        return F.coalesce(F.col(f"{kind}_{side}"), F.col(f"{kind}_{other}"))

    found = looked_up.groupBy("t_us", "t_seq").agg(
        F.first("t_kept").alias("t_kept"),
        *[F.max(F.when(is_now, nearest(k, "before", "earlier"))).alias(f"{k}_before") for k in KINDS],
        *[F.max(F.when(is_now, nearest(k, "after", "later"))).alias(f"{k}_after") for k in KINDS],
        *[F.max(F.when(~is_now, nearest(k, "after", "later"))).alias(f"{k}_open") for k in KINDS],
    )
    t = F.col("t_us")

    def pair(p, n):
        latest = F.greatest(p["at"]["us"], n["at"]["us"], t)
        earliest = F.least(p["at"]["us"], n["at"]["us"], t)
        span = latest - earliest
        return F.when(
            p.isNotNull() & n.isNotNull() & (span <= window_us),
            F.struct(
                span.alias("span"),
                F.abs(p["at"]["us"] - t).alias("p_gap"),
                (p["at"]["us"] > t).alias("p_later"),
                F.abs(n["at"]["us"] - t).alias("n_gap"),
                (n["at"]["us"] > t).alias("n_later"),
                p.alias("p"),
                n.alias("n"),
            ),
        )

    sides = ("before", "after")
    closest = F.array_min(
        F.array_compact(F.array(*[pair(F.col(f"p_{a}"), F.col(f"n_{b}")) for a in sides for b in sides]))
    )
    trailing = F.when(
        (F.col("p_open")["at"] <= t_at) & (F.col("n_open")["at"] <= t_at),
        pair(F.col("p_open"), F.col("n_open")),
    )

    def event(kind):
        fact = F.col(f"pair.{kind}")
        return F.struct(
            fact["at"]["us"].alias("us"),
            fact["at"]["seq"].alias("seq"),
            *[fact["kept"][c].alias(c) for c in keep],
        )

    return (
        found.select(
            t.alias("us"), F.col("t_seq").alias("seq"), "t_kept", F.coalesce(trailing, closest).alias("pair")
        )
        .where("pair is not null")
        .select(
            "us",
            "seq",
            *[F.col("t_kept")[c].alias(c) for c in keep],
            event("p").alias("first_event"),
            event("n").alias("second_event"),
        )
    )
