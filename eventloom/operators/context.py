"""Trailing-window context primitives.

The context of an event ``e`` is every event ``c`` with ``e.us - W <= c.us`` and
``(c.us, c.seq) <= (e.us, e.seq)``. It is never materialised. Each primitive is a sweep:
an event raises a level when it arrives and lowers it one microsecond after it has left
the window, and the context measure of ``e`` is the running sum of these deltas.

A running sum over a whole key would put a hot key into one task. So the time axis is cut
into slices: the sum runs inside ``(key, slice)``, and what earlier slices left behind is
added from a small table of slice totals, pre-aggregated on the map side. The slice length
has nothing to do with the window length, so a key that holds a third of the data is still
spread over as many tasks as it has busy slices. The slice totals of a key are cut once more,
into blocks of slices, so that a key with millions of slices is not one task either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

MICROS = 1_000_000
DEFAULT_SLICE_SECS = 3600
SLICES_OF_A_BLOCK = 1024
PACK = 1 << 63  # (us, seq) packed into one ordered decimal: us * 2^63 + seq


def window_micros(window_secs: float) -> int:
    return int(round(window_secs * MICROS))


def slice_micros(window_us: int, slice_secs: float | None) -> int:
    """Slice length: as asked for, else the window but at most an hour; at least 1 microsecond."""
    if slice_secs is not None:
        return max(1, window_micros(slice_secs))
    return max(1, min(window_us, DEFAULT_SLICE_SECS * MICROS))


def whole_division(number: Column, divisor: Column) -> Column:
    """Floor division that stays exact for bigint and decimal."""
    return F.call_function("div", number - F.pmod(number, divisor), divisor)


def slice_of(us: Column, length_us: int) -> Column:
    return whole_division(us, F.lit(length_us).cast("bigint"))


def _pack_divisor() -> Column:
    return F.lit(str(PACK)).cast("decimal(38,0)")


def pack(us: Column, seq: Column) -> Column:
    """(us, seq) as one decimal: min/max of it stay in a hash aggregate, a struct would not."""
    scaled = us.cast("decimal(18,0)") * F.lit(str(PACK)).cast("decimal(19,0)")
    return (scaled + seq.cast("decimal(19,0)")).cast("decimal(38,0)")


def unpack_us(packed: Column) -> Column:
    return whole_division(packed, _pack_divisor())


def unpack_seq(packed: Column) -> Column:
    return F.pmod(packed, _pack_divisor()).cast("bigint")


# --- deltas ----------------------------------------------------------------------------


def sweep(
    rows: DataFrame, keys: Sequence[str], measures: Sequence[str], window_us: Column
) -> DataFrame:
    """Rows of a sweep from event rows with ``us``, ``seq``, ``_member``, ``_emit``, ``_probe``
    and ``_keep``: a member raises its measures on arrival and lowers them after it has left
    the window; a row that is only read raises nothing. What is kept travels once."""
    us, member = F.col("us"), F.col("_member")

    def step(at, late, measure):
        return F.struct(
            at.alias("us"), F.lit(late).alias("_late"), *[measure(F.col(m)).alias(m) for m in measures]
        )

    def while_member(value):
        return F.when(member, value).otherwise(value - value)

    arrival = step(us, 1, while_member)
    departure = step(us + window_us + F.lit(1), 0, lambda value: -value)
    steps = F.when(member, F.array(arrival, departure)).otherwise(F.array(arrival))
    is_arrival = F.col("_step._late") == 1
    return rows.select(*keys, "seq", "_probe", "_emit", "_keep", F.explode_outer(steps).alias("_step")).select(
        *keys,
        "_step.us",
        "seq",
        "_step._late",
        "_probe",
        (F.col("_emit") & is_arrival).alias("_emit"),
        *[F.col(f"_step.{m}").alias(m) for m in measures],
        F.when(is_arrival & F.col("_emit"), F.col("_keep")).alias("_keep"),
    )


def event_rows(
    df: DataFrame,
    keys: Mapping[str, Column],
    member: Column,
    emit: Column,
    measures: Mapping[str, Column],
    keep: Sequence[str],
    probe: bool = False,
) -> DataFrame:
    """The event rows of a sweep: those that are members or are read."""
    kept = F.struct(*keep) if keep else F.struct(F.lit(1).alias("_"))
    return df.select(
        *[c.alias(n) for n, c in keys.items()],
        "us",
        "seq",
        F.coalesce(member, F.lit(False)).alias("_member"),
        F.coalesce(emit, F.lit(False)).alias("_emit"),
        F.lit(int(probe)).alias("_probe"),
        *[c.alias(n) for n, c in measures.items()],
        kept.alias("_keep"),
    ).where("_member or _emit")


def presence_deltas(
    members: DataFrame,
    keys: Sequence[str],
    value: str,
    measure: str,
    window_us: int,
    slice_us: int,
) -> DataFrame:
    """+1 when a value enters the window of its key, -1 after its last sighting has left.

    Sightings of one (key, value) inside a slice no longer than the window form one unbroken
    presence, so they collapse to first and last before the shuffle, however hot the pair is.
    """
    pair = [*keys, value]
    length = max(1, min(slice_us, window_us))
    at = pack(F.col("us"), F.col("seq"))
    seen = (
        members.where(F.col(value).isNotNull())
        .groupBy(*pair, slice_of(F.col("us"), length).alias("_piece"))
        .agg(F.min(at).alias("_first"), F.max("us").alias("_last"))
        .withColumn("_first_us", unpack_us(F.col("_first")))
    )
    along = Window.partitionBy(*pair).orderBy("_piece")
    gap_before = F.col("_first_us") - F.lag("_last").over(along) > F.lit(window_us)
    gap_after = F.lead("_first_us").over(along) - F.col("_last") > F.lit(window_us)
    edges = seen.select(
        *keys,
        "_first_us",
        unpack_seq(F.col("_first")).alias("_seq"),
        "_last",
        F.coalesce(gap_before, F.lit(True)).alias("_opens"),
        F.coalesce(gap_after, F.lit(True)).alias("_closes"),
    )

    def edge(at, late, delta):
        return F.struct(
            at.alias("us"),
            F.col("_seq").alias("seq"),
            F.lit(late).alias("_late"),
            F.lit(0).alias("_probe"),
            F.lit(False).alias("_emit"),
            F.lit(delta).cast("bigint").alias(measure),
        )

    return edges.select(
        *keys,
        F.inline_outer(
            F.array_compact(
                F.array(
                    F.when(F.col("_opens"), edge(F.col("_first_us"), 1, 1)),
                    F.when(F.col("_closes"), edge(F.col("_last") + F.lit(window_us + 1), 0, -1)),
                )
            )
        ),
    ).where("us is not null")


def running_levels(
    deltas: DataFrame, keys: Sequence[str], measures: Sequence[str], slice_us: int
) -> DataFrame:
    """Running sum of every measure per key, for the rows flagged ``_emit``.

    Order inside a key: departures first at their time (``_late`` 0), then by ``seq``, the
    deltas of an event before its probe (``_probe`` 1).
    """
    cut = deltas.withColumn("_slice", slice_of(F.col("us"), slice_us))
    group = [*keys, "_slice"]
    so_far = (
        Window.partitionBy(*group)
        .orderBy("us", "_late", "seq", "_probe")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = cut.select(
        *group, "us", "seq", "_emit", "_keep", *[F.sum(m).over(so_far).alias(m) for m in measures]
    ).where("_emit")

    # One row per key and busy slice: bounded by elapsed time, not by the number of events.
    # Rows with a null key are nobody's context, and the join below would not find their totals.
    totals = cut.where(_no_null_key(keys)).groupBy(*group).agg(
        F.max("_emit").alias("_wanted"), *[F.sum(m).alias(m) for m in measures]
    )
    carried = carried_levels(totals, keys, measures)

    return inside.join(carried, group, "left").select(
        *keys,
        "us",
        "seq",
        *[
            (F.coalesce(F.col(m), F.lit(0)) + F.coalesce(F.col(f"_carry_{m}"), F.lit(0))).alias(m)
            for m in measures
        ],
        "_keep",
    )


def carried_levels(totals: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """What earlier slices of its key leave to each wanted slice, where that is not zero.

    ``totals`` has one row per key and slice. A key with very many slices is cut into blocks of them: block totals run along
    the key, one row per block, and what they give opens the running sum inside the block. So no task sees all slices of
    a key, only all its blocks.
    """
    along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocked = totals.withColumn("_block", slice_of(F.col("_slice"), SLICES_OF_A_BLOCK))
    blocks = blocked.groupBy(*keys, "_block").agg(F.max("_wanted").alias("_wanted"), *[F.sum(m).alias(m) for m in measures])
    # Renamed keys, and the openings first in the union: so both branches keep the same plan up to the totals, and the
    # shuffle that makes them is run once.
    openings = blocks.select(
        *[F.col(k).alias(k) for k in keys], F.col("_block").alias("_block"), F.lit(None).cast("bigint").alias("_slice"),
        F.col("_wanted").alias("_wanted"), *[F.sum(m).over(along).alias(m) for m in measures],
    ).where("_wanted")

    inside = Window.partitionBy(*keys, "_block").orderBy(F.col("_slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    opened = openings.unionByName(blocked)
    carried = opened.select(
        *keys, "_slice", "_wanted", *[F.sum(m).over(inside).alias(f"_carry_{m}") for m in measures]
    )
    not_zero = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_carry_{m}") != 0, F.lit(False)) for m in measures])
    return carried.where(F.col("_slice").isNotNull() & F.col("_wanted") & not_zero).drop("_wanted")


# --- primitives ------------------------------------------------------------------------


def _true(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else condition


def _key_columns(keys: Sequence[str]) -> dict[str, Column]:
    """Without keys the whole stream is one key; slices still spread it."""
    return {k: F.col(k) for k in keys} or {"_all": F.lit(0)}


def _no_null_key(keys: Sequence[str]) -> Column:
    return reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))


def trailing_sum(
    df: DataFrame,
    keys: Sequence[str],
    window_secs: float,
    value: Column,
    *,
    member: Column | None = None,
    emit: Column | None = None,
    keep: Sequence[str] = (),
    out: str = "total",
    slice_secs: float | None = None,
) -> DataFrame:
    """Sum of ``value`` over the trailing context, the event itself included.

    One output row per ``emit`` event: the keys, ``us``, ``seq``, the kept columns and the
    sum. An event with a null key neither counts nor is counted; its sum is 0.
    """
    window_us = window_micros(window_secs)
    key_columns = _key_columns(keys)
    counts = _true(member) & value.isNotNull() & _no_null_key(keys)
    rows = event_rows(df, key_columns, counts, _true(emit), {out: value}, keep)
    deltas = sweep(rows, list(key_columns), [out], F.lit(window_us))
    levels = running_levels(deltas, list(key_columns), [out], slice_micros(window_us, slice_secs))
    return levels.select(*keys, "us", "seq", *[F.col("_keep")[c].alias(c) for c in keep], out)


def trailing_count(df: DataFrame, keys: Sequence[str], window_secs: float, *, out: str = "n", **options) -> DataFrame:
    """Number of ``member`` events in the trailing context of each ``emit`` event."""
    return trailing_sum(df, keys, window_secs, F.lit(1).cast("bigint"), out=out, **options)


def trailing_distinct(
    df: DataFrame,
    keys: Sequence[str],
    window_secs: float,
    value: Column,
    *,
    member: Column | None = None,
    emit: Column | None = None,
    keep: Sequence[str] = (),
    out: str = "n",
    slice_secs: float | None = None,
) -> DataFrame:
    """Exact number of distinct non-null values in the trailing context of each ``emit`` event."""
    window_us = window_micros(window_secs)
    slice_us = slice_micros(window_us, slice_secs)
    key_columns = _key_columns(keys)
    members = df.where(_true(member) & _no_null_key(keys)).select(
        *[c.alias(k) for k, c in key_columns.items()], "us", "seq", value.alias("_value")
    )
    nothing = {out: F.lit(0).cast("bigint")}
    rows = event_rows(df, key_columns, F.lit(False), _true(emit), nothing, keep, probe=True)
    probes = sweep(rows, list(key_columns), [out], F.lit(window_us))
    edges = presence_deltas(members, list(key_columns), "_value", out, window_us, slice_us)
    deltas = probes.unionByName(edges, allowMissingColumns=True)
    levels = running_levels(deltas, list(key_columns), [out], slice_us)
    return levels.select(*keys, "us", "seq", *[F.col("_keep")[c].alias(c) for c in keep], out)


def type_present(
    df: DataFrame,
    window_secs: float,
    *,
    member: Column,
    emit: Column,
    keys: Sequence[str] = (),
    keep: Sequence[str] = (),
    out: str = "present",
    slice_secs: float | None = None,
) -> DataFrame:
    """Whether any ``member`` event lies in the trailing context. The members collapse to one
    presence per slice before the shuffle, so a frequent type costs no more than a rare one."""
    found = trailing_distinct(
        df, keys, window_secs, F.lit(1), member=member, emit=emit, keep=keep, out="_n", slice_secs=slice_secs
    )
    return found.withColumn(out, F.col("_n") > 0).drop("_n")


def preceding_matches(
    df: DataFrame,
    keys: Sequence[str],
    window_secs: float,
    *,
    trigger: Column,
    preceding: Column,
    at_least: int,
    keep: Sequence[str] = (),
    out: str = "n",
    slice_secs: float | None = None,
) -> DataFrame:
    """Triggers with at least so many ``preceding`` events of the same keys in their context."""
    counted = trailing_count(
        df, keys, window_secs, member=preceding, emit=trigger, keep=keep, out=out, slice_secs=slice_secs
    )
    return counted.where(F.col(out) >= at_least)


# --- gates -----------------------------------------------------------------------------


def every_nth(level: Column, n: int) -> Column:
    """Fires while the level is a positive multiple of ``n``: a test of the level, not of a crossing."""
    return (level >= n) & (level % n == 0)


def crosses_multiple(now: Column, before: Column, step: int) -> Column:
    """Fires when the level reaches a new multiple of ``step``."""
    by = F.lit(step)
    return (now >= step) & (F.call_function("div", now, by) > F.call_function("div", before, by))
