"""Canonical event and detection schemas, and small column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .fixed_values import SEVERITIES, SEVERITY_WEIGHT, THREAT_BANDS

SOURCE_TYPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("facility", T.IntegerType()),
    ]
)

# Metadata keys that rules read. They are stored as columns so that a rule never forces
# the scan to read the whole metadata map.
PROMOTED = [
    "host", "user", "cmd", "parent_image", "exe", "pid", "source_ip", "dst_ip", "dst_port",
    "bytes_out", "query", "file_path", "registry_key", "registry_value", "service_name",
    "path", "target", "filename", "name", "key", "value", "resolver",
]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("us", T.LongType()),
        T.StructField("source", SOURCE_TYPE),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_type_raw", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("severity_rank", T.IntegerType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
    + [T.StructField(name, T.StringType()) for name in PROMOTED]
)

DETECTION_COLUMNS = [
    "detection_id", "rule_id", "rule_name", "description", "severity", "event_ids", "trigger_seq",
    "event_ts", "host", "detected_at", "score_contribution", "tags", "evidence",
]

DETECTION_SCHEMA = T.StructType(
    [
        T.StructField("detection_id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("event_ids", T.ArrayType(T.StringType())),
        T.StructField("trigger_seq", T.LongType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("host", T.StringType()),
        T.StructField("detected_at", T.TimestampType()),
        T.StructField("score_contribution", T.LongType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("evidence", T.ArrayType(T.StringType())),
    ]
)


def severity_weight(severity: Column) -> Column:
    out = F.lit(None).cast("bigint")
    for name, weight in SEVERITY_WEIGHT.items():
        out = F.when(severity == name, F.lit(weight).cast("bigint")).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for rank, name in enumerate(SEVERITIES):
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def threat_level(score: Column) -> Column:
    out = F.lit(THREAT_BANDS[-1][1])
    for floor, name in reversed(THREAT_BANDS[:-1]):
        out = F.when(score >= floor, F.lit(name)).otherwise(out)
    return out


def source_display(source: Column) -> Column:
    """``kind:name``, or the kind alone when there is no name."""
    return F.concat_ws(":", source["kind"], source["name"])
