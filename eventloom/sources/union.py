"""Several inputs of several kinds as one stream of raw records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .lines import DEFAULT_HOST, number_repeats, read_json_events, read_syslog_events
from .packets import packet_records
from .winlog import read_winlog_events

def union_records(frames: Sequence[DataFrame]) -> DataFrame:
    """Raw records of any number of readers. Arrival numbers keep inputs in order: the upper bits name the input, as many as
    the inputs need. A number too large for the rest is an error, never a collision."""
    if not frames:
        raise ValueError("no source: give at least one input")
    if len(frames) == 1:
        return frames[0]
    share = 1 << (63 - (len(frames) - 1).bit_length())
    too_large = F.raise_error(F.concat(F.lit("seq does not fit below "), F.lit(share), F.lit(": "), F.col("seq"))).cast("bigint")
    fits = F.col("seq").between(0, share - 1)
    shifted = [f.withColumn("seq", F.when(fits, F.col("seq") + F.lit(i * share)).otherwise(too_large)) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, shifted)


def read_sources(
    spark: SparkSession,
    *,
    winlog: Sequence[str] = (),
    packets: Sequence[DataFrame] = (),
    syslog: Sequence[str] = (),
    json: Sequence[str] = (),
    default_host: str = DEFAULT_HOST,
    received_at: Column | None = None,
    ignore_missing: bool = False,
    skip_unreadable: bool = False,
    content_ids: bool = False,
) -> DataFrame:
    """Raw records of all inputs. With ``content_ids`` repeats are numbered here, so that event ids come from content alone."""
    options = {"received_at": received_at, "ignore_missing": ignore_missing, "skip_unreadable": skip_unreadable}
    frames = []
    if winlog:
        frames.append(read_winlog_events(spark, winlog, **options))
    frames += [packet_records(p) for p in packets]
    if syslog:
        frames.append(read_syslog_events(spark, syslog, default_host=default_host, **options))
    if json:
        frames.append(read_json_events(spark, json, **options))
    records = union_records(frames)
    return number_repeats(records) if content_ids else records
