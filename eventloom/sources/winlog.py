"""Exported Windows event records: one JSON record per row, nested as the exporters write it,
flattened to the plain object the normaliser expects."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import WINDOWS_FIELDS
from ..functions.text import parse_u64
from ..operators.normalize import JSON_OPTIONS, first_of_each_key, typed_map
from .lines import _records, json_lines, read_lines, source_column

NUMBERS = ("BIG", "DEC", "DOU", "FLO")


def _object(member: Column) -> Column:
    """Members of a nested object; null when the member is not an object."""
    return typed_map(F.when(member["s"] == "OBJ", member["t"]))


def _variant_string(value: Column, path: str) -> Column:
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string"))


def _inner_text(member: Column, path: str) -> Column:
    """A string inside an object member."""
    return F.when(member["s"] == "OBJ", _variant_string(F.try_parse_json(member["t"]), path))


def _scalar(member: Column) -> Column:
    """Text of a string or number, or the ``#text`` of an object."""
    return F.when(member["s"].isin("STR", *NUMBERS), member["t"]).otherwise(_inner_text(member, "$['#text']"))


def canonical_field(name: Column) -> Column:
    """Canonical key of a Windows field name; names not in the table are lower-cased."""
    table = F.from_json(F.lit(json.dumps(WINDOWS_FIELDS)), "map<string,string>")
    return F.coalesce(table[name], F.lower(name))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _of_members(members: Column) -> Column:
    return F.transform(
        F.map_entries(members), lambda e: _entry(canonical_field(e["key"]), _scalar(e["value"]))
    )


def _of_list(data: Column) -> Column:
    items = F.from_json(F.when(data["s"] == "ARR", data["t"]), "array<variant>", JSON_OPTIONS)
    return F.transform(
        items,
        lambda item: _entry(
            canonical_field(_variant_string(item, "$['#attributes'].Name")), _variant_string(item, "$['#text']")
        ),
    )


def flatten_records(df: DataFrame, raw: str, out: str = "flat") -> DataFrame:
    """Flat JSON of exported records; a record without ``Event`` passes through.

    One nesting level per projection, so that each is parsed once.
    """
    event, system, data = F.col("_event"), F.col("_system"), F.col("_data")
    staged = (
        df.withColumn("_top", typed_map(F.col(raw)))
        .withColumn("_event", _object(F.col("_top")["Event"]))
        .withColumns({"_system": _object(event["System"]), "_details": _object(event["EventData"])})
        .withColumn("_data", F.col("_details")["Data"])
    )
    head = F.array(
        _entry(F.lit("channel"), _scalar(system["Channel"])),
        _entry(F.lit("host"), _scalar(system["Computer"])),
        _entry(F.lit("timestamp"), _inner_text(system["TimeCreated"], "$['#attributes'].SystemTime")),
        _entry(F.lit("Level"), _scalar(system["Level"])),
    )
    fields = (
        F.when(data["s"] == "ARR", _of_list(data))
        .when(data["s"] == "OBJ", _of_members(_object(data)))
        .otherwise(_of_members(F.map_filter("_details", lambda k, v: k != "Data")))
    )
    staged = staged.withColumn("_fields", fields)
    known = F.filter(
        F.when(F.col("_fields").isNull(), head).otherwise(F.concat(head, F.col("_fields"))),
        lambda e: e["key"].isNotNull() & e["value"].isNotNull(),
    )
    staged = staged.withColumns(
        {"_known": known, "_number": parse_u64(_scalar(system["EventID"])).cast("string")}
    ).withColumn("_text", F.to_json(F.map_from_entries(first_of_each_key(F.col("_known")))))
    # The event id is the one value that stays a number.
    text, number = F.col("_text"), F.col("_number")
    rest = F.when(text == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(text, 2, 2**31 - 1)))
    flat = F.when(number.isNull(), text).otherwise(F.concat(F.lit('{"EventID":'), number, rest))
    has_event = F.coalesce(F.map_contains_key("_top", F.lit("Event")), F.lit(False))
    return staged.select(*df.columns, F.when(has_event, flat).otherwise(F.col(raw)).alias(out))


def winlog_records(lines: DataFrame, received_at: Column | None = None) -> DataFrame:
    flat = flatten_records(json_lines(lines), "value")
    return _records(flat, source_column("evtx", F.col("file"), channel=""), F.col("flat"), received_at)


def read_winlog_events(spark, paths, *, received_at: Column | None = None, **reading: bool) -> DataFrame:
    """Exported record JSON, one record per line."""
    return winlog_records(read_lines(spark, paths, **reading), received_at)
