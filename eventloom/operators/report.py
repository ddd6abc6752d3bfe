"""Aggregates over detections, the report record and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..fixed_values import SEVERITIES
from ..schema import source_display, threat_level


def _total_score() -> Column:
    """Additive and not capped."""
    return F.coalesce(F.sum("score_contribution"), F.lit(0)).cast("bigint")


def _severity_counts() -> list[Column]:
    return [F.count("*").alias("total")] + [
        F.count_if(F.col("severity") == name).alias(name.lower()) for name in reversed(SEVERITIES)
    ]


def severity_summary(detections: DataFrame) -> DataFrame:
    """One row: the total and the count per severity."""
    return detections.agg(*_severity_counts())


def score_level(detections: DataFrame) -> DataFrame:
    """One row: the score and its threat level."""
    return detections.agg(_total_score().alias("score")).withColumn("threat_level", threat_level(F.col("score")))


def detections_by_rule(detections: DataFrame) -> DataFrame:
    return detections.groupBy("rule_id", "severity").agg(F.count("*").alias("detections"))


def events_by_source(events: DataFrame) -> DataFrame:
    return events.groupBy(source_display(F.col("source")).alias("source")).agg(F.count("*").alias("events"))


def host_day_score(detections: DataFrame) -> DataFrame:
    """Score and threat level per host and day; detections without a host share ``unknown``."""
    return (
        detections.groupBy(
            F.coalesce(F.col("host"), F.lit("unknown")).alias("host"),
            F.window("event_ts", "1 day").alias("day"),
        )
        .agg(F.count("*").alias("detections"), _total_score().alias("score"))
        .select(
            "host",
            F.date_format("day.start", "yyyy-MM-dd").alias("day"),
            "detections",
            "score",
            threat_level(F.col("score")).alias("threat_level"),
        )
    )


def report_header(
    events: DataFrame | int, detections: DataFrame, duration_secs: float | Column = 0.0, generated_at: Column | None = None
) -> DataFrame:
    """The report without its detections list, as one row: events processed, score, summary.

    Both inputs are aggregated to one row before they meet. Pass stored or cached detections;
    else they are computed here once more. In place of the events their number may be given, as ``write_events`` returns it.
    """
    duration = duration_secs if isinstance(duration_secs, Column) else F.lit(float(duration_secs))
    summed = detections.agg(_total_score().alias("_score"), *_severity_counts())
    if isinstance(events, int):
        counted = summed.withColumn("events_processed", F.lit(events).cast("bigint"))
    else:
        counted = events.agg(F.count("*").alias("events_processed")).crossJoin(summed)
    return assembled(counted, duration, generated_at)


def assembled(counts: DataFrame, duration: Column, generated_at: Column | None = None) -> DataFrame:
    """The report record from one row with events_processed, _score, total and the count per severity."""
    names = ["total", *[s.lower() for s in reversed(SEVERITIES)]]
    return counts.select(
        (F.current_timestamp() if generated_at is None else generated_at).alias("generated_at"),
        duration.alias("duration_secs"),
        "events_processed",
        F.struct(F.col("_score").alias("score"), threat_level(F.col("_score")).alias("threat_level")).alias("score"),
        F.struct(*names).alias("summary"),
    )


def report_json(header: DataFrame, pretty: bool = False) -> DataFrame:
    """The report header as one JSON text."""
    options = {"pretty": "true"} if pretty else {}
    return header.select(F.to_json(F.struct(*header.columns), options).alias("report"))


def ordered(detections: DataFrame) -> DataFrame:
    """Reading order for a listing."""
    return detections.orderBy("event_ts", "rule_id", "trigger_seq")


def write_detections(detections: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    detections.write.format(fmt).mode(mode).save(path)


def write_events(events: DataFrame, path: str, mode: str = "errorifexists", files_per_day: int = 4) -> int:
    """Store normalised events by type and day, so that each rule family reads only its own
    types and any time filter prunes whole folders. A type's day goes to ``files_per_day`` tasks,
    and so to as many files, however many tasks read the input.

    Returns how many events were written, counted while they are written. The count stands behind the shuffle, in the
    tasks that write, because a map task that runs again after a lost executor would count its rows twice.
    """
    salt = F.pmod(F.xxhash64("seq"), F.lit(files_per_day))
    written = Observation()
    (
        events.withColumn("day", F.to_date("ts"))
        .repartition("event_type", "day", salt)
        .observe(written, F.count(F.lit(1)).alias("events"))
        .write.partitionBy("event_type", "day")
        .mode(mode)
        .parquet(path)
    )
    return written.get["events"]


def write_report(header: DataFrame, detections: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON report: one header record, and the detections as JSON lines next to it."""
    report_json(header).write.mode(mode).text(f"{path}/header")
    detections.write.mode(mode).json(f"{path}/detections")
