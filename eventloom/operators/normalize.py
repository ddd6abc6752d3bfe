"""Normalisation: raw JSON records to canonical events, as one projection without a shuffle.

A record that is one flat JSON object takes a single map parse; only records with nested
objects or arrays pay for the level-by-level expansion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (
    EVENT_ID_TYPES,
    EVENT_TYPES,
    EXTENDED_ALIASES,
    FIELD_ALIASES,
    NUMERIC_LEVELS,
    SEVERITIES,
    TIMESTAMP_KEYS,
)
from ..functions.json_batches import ESCAPES, LEVELS, MARK, rewritten_json
from ..functions.text import parse_u64
from ..schema import EVENT_SCHEMA, PROMOTED, severity_rank

# Standard JSON only: no single quotes, no NaN.
JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
TEXT_MAP = "map<string,string>"
TYPED_MAP = "map<string,variant>"

TYPED_KEYS = ["event_type", "EventID", "severity", "Level", *TIMESTAMP_KEYS]

# Date, time and zone as RFC 3339 has them; the parser alone would accept less than that.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def let(value: Column, use) -> Column:
    """Bind a costly value once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _one(raw: Column, element: str) -> Column:
    """Parse exactly one JSON value. Wrapping it as a one-element array makes text after the
    value an error, which a plain parse would silently ignore."""
    parsed = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), f"array<{element}>", JSON_OPTIONS)
    return let(parsed, lambda p: F.when(F.size(p) == 1, F.get(p, F.lit(0))))


def json_object(raw: Column) -> Column:
    """Top-level keys and value texts of a JSON object; null for anything else."""
    return _one(raw, TEXT_MAP)


#: What one JSON value can begin with; all else is settled without a parse.
JSON_START = r'^[ \t\n\r]*([{\["0-9-]|(true|false|null)[ \t\n\r]*$)'


def _odd(raw: Column) -> Column:
    """The text if it may be JSON but the variant parser does not settle it, else null.

    That parser ignores text after a value, so the value is wrapped in two ways, which only one value passes both; and it
    rejects repeated keys.
    """

    def parses(before, after):
        return F.try_parse_json(F.concat(F.lit(before), raw, F.lit(after))).isNotNull()

    unmarked = ~F.contains(raw, F.lit(MARK)) & ~F.contains(raw, F.lit("\\u0001"))
    plain = unmarked & parses("[", "]") & parses('{"v":', "}") & is_shallow(raw)
    return F.when(raw.rlike(JSON_START), F.when(~F.coalesce(plain, F.lit(False)), raw))


def _settled(raw: Column, odd: Column) -> Column:
    return F.when(odd.isNotNull(), rewritten_json(odd)).when(raw.rlike(JSON_START), raw)


def json_text(raw: Column) -> Column:
    """The text if it is exactly one JSON value, else null. Of repeated keys the last one is kept.

    The variant parser settles nearly every line. What it rejects, records deeper than LEVELS and the rare ones with the
    mark of lifted leaves in them are read once more in Arrow batches, where deep leaves are lifted (other lines pass as null).
    """
    return _settled(raw, _odd(raw))


def with_json_text(lines: DataFrame, raw: str, out: str) -> DataFrame:
    """The lines with ``json_text`` of a column, parsed once: a projection of its own keeps what both uses need."""
    return lines.withColumn("_odd", _odd(F.col(raw))).withColumn(out, _settled(F.col(raw), F.col("_odd"))).drop("_odd")


def is_shallow(raw: Column) -> Column:
    """Whether objects of a JSON text lie at most LEVELS deep in one another. Texts are taken out first, as their braces
    do not count; then the innermost objects go, level by level. Only records with many braces pay for it."""
    few = F.length(raw) - F.length(F.replace(raw, F.lit("{"), F.lit(""))) <= LEVELS + 1
    rest = F.regexp_replace(F.regexp_replace(raw, r"\\.", ""), r'"[^"]*"', "")
    for _ in range(LEVELS + 1):
        rest = F.regexp_replace(rest, r"\{[^{}]*\}", "")
    return few | ~F.contains(rest, F.lit("{"))


def is_json(raw: Column) -> Column:
    """Whether the text is exactly one JSON value, object or not."""
    return json_text(raw).isNotNull()


# --- flattening ------------------------------------------------------------------------


def _shape(value: Column) -> Column:
    """First letters of the variant type: OBJ, ARR, VOI, or a scalar type."""
    return F.substring(F.schema_of_variant(value), 1, 3)


def typed_map(text: Column) -> Column:
    """Members of a JSON object text as map<key, struct<t, s>>: value text and type letters."""
    return F.map_zip_with(
        F.from_json(text, TEXT_MAP, JSON_OPTIONS),
        F.from_json(text, TYPED_MAP, JSON_OPTIONS),
        lambda k, t, v: F.struct(t.alias("t"), _shape(v).alias("s")),
    )


def typed_elements(text: Column) -> Column:
    """Elements of a JSON array text as array<struct<t, s>>."""
    texts = F.from_json(text, "array<string>", JSON_OPTIONS)
    shapes = F.transform(F.from_json(text, "array<variant>", JSON_OPTIONS), _shape)
    return F.zip_with(texts, shapes, lambda t, s: F.struct(t.alias("t"), s.alias("s")))


def _typed(text: Column) -> Column:
    return F.map_entries(typed_map(text))


def _joined_scalars(text: Column) -> Column:
    """Scalar elements of a JSON array text, joined by commas; null when there are none."""
    kept = F.filter(
        F.transform(typed_elements(text), lambda e: F.when(~e["s"].isin("OBJ", "ARR", "VOI"), e["t"])),
        lambda t: t.isNotNull(),
    )
    joined = F.array_join(kept, ",")
    return F.when(joined != "", joined)


def _node(path: Column, key: Column, typed: Column) -> Column:
    return F.struct(path.alias("path"), key.alias("key"), typed["t"].alias("t"), typed["s"].alias("s"))


def _children(node: Column) -> Column:
    return F.transform(
        _typed(node["t"]),
        lambda e: _node(F.concat(node["path"], F.lit("."), e["key"]), e["key"], e["value"]),
    )


def _unescaped(text: Column) -> Column:
    for char, code in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _lifted_children(node: Column) -> Column:
    """Children at the last level: leaves that were lifted there get their full path and their own key back."""

    def child(e):
        key, after = e["key"], F.substring(e["key"], 2, 2**31 - 1)
        lifted, deep = F.startswith(key, F.lit(MARK)), F.contains(after, F.lit(MARK))
        last = F.when(lifted, _unescaped(F.substring_index(after, MARK, -1))).otherwise(key)
        between = F.when(lifted & deep, F.concat(_unescaped(F.substring_index(after, MARK, 1)), F.lit("."))).otherwise(F.lit(""))
        return _node(F.concat(node["path"], F.lit("."), between, last), last, e["value"])

    return F.transform(_typed(node["t"]), child)


def _leaf_value(node: Column) -> Column:
    return (
        F.when(node["s"] == "ARR", _joined_scalars(node["t"]))
        .when(node["s"] == "VOI", F.lit(None))
        .otherwise(node["t"])
    )


def _as_entries(nodes: Column, name: str) -> Column:
    return F.filter(
        F.transform(nodes, lambda n: F.struct(n[name].alias("key"), _leaf_value(n).alias("value"))),
        lambda e: e["value"].isNotNull(),
    )


def first_of_each_key(entries: Column) -> Column:
    names = F.transform(entries, lambda e: e["key"])
    return F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)


def _is_object(node: Column) -> Column:
    return node["s"] == "OBJ"


def with_flat_map(df: DataFrame, raw: str, top: str, out: str, depth: int = LEVELS) -> DataFrame:
    """JSON object text to a flat map of texts; not an object: empty map.

    Nested keys are joined by dots, and a nested scalar is also reachable by its last segment
    where that key is free. Precedence: top-level keys, dotted paths, then short keys by
    smallest path.

    One level per projection, so that every level is parsed once; all of it stays in one stage,
    and the levels of a flat record are null. ``json_text`` has lifted what lay deeper.
    """
    body = F.substring(F.trim(raw), 2, 2**31 - 1)
    is_nested = F.col(top).isNotNull() & (F.contains(body, F.lit("{")) | F.contains(body, F.lit("[")))
    start = F.transform(_typed(F.col(raw)), lambda e: _node(e["key"], e["key"], e["value"]))
    staged = df.withColumn("_level0", F.when(is_nested, start))
    levels = [F.col("_level0")]
    for i in range(1, depth + 1):
        below = F.flatten(F.transform(F.filter(levels[-1], _is_object), _lifted_children if i == depth else _children))
        staged = staged.withColumn(f"_level{i}", below)
        levels.append(F.col(f"_level{i}"))
    leaves = [F.filter(level, lambda n: ~_is_object(n)) for level in levels]
    staged = staged.withColumn("_inner", F.concat(*leaves[1:]))
    short = F.array_sort(F.filter("_inner", lambda n: ~n["s"].isin("OBJ", "ARR", "VOI")))
    staged = staged.withColumn(
        "_entries",
        F.concat(_as_entries(leaves[0], "path"), _as_entries(F.col("_inner"), "path"), _as_entries(short, "key")),
    )
    flat = (
        F.when(F.col(top).isNull(), F.from_json(F.lit("{}"), TEXT_MAP))
        .when(F.col("_entries").isNotNull(), F.map_from_entries(first_of_each_key(F.col("_entries"))))
        .otherwise(F.map_filter(top, lambda k, v: v.isNotNull()))
    )
    return staged.withColumn(out, flat).drop(*[f"_level{i}" for i in range(depth + 1)], "_inner", "_entries")


# --- classification --------------------------------------------------------------------


def typed_fields(raw: Column) -> Column:
    """The keys whose JSON type matters, as variants."""
    return _one(raw, "struct<" + ",".join(f"`{k}`:variant" for k in TYPED_KEYS) + ">")


def _string_field(fields: Column, key: str) -> Column:
    value = fields[key]
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))


def _unsigned_field(fields: Column, top: Column, key: str) -> Column:
    """Non-negative integer; its digits are taken from the text, its type from the variant."""
    is_number = F.schema_of_variant(fields[key]) != "STRING"
    return F.when(is_number & top[key].rlike("^[0-9]+$"), parse_u64(top[key]))


def _lookup(table: dict, key: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, name in table.items():
        out = F.when(key == value, F.lit(name)).otherwise(out)
    return out


def classify_type(named: Column, event_id: Column) -> Column:
    """struct(event_type, event_type_raw) from the named type or else the numeric event id."""
    known = F.when(named.isin(*EVENT_TYPES), named)
    by_id = F.when(named.isNull(), _lookup(EVENT_ID_TYPES, event_id))
    found = F.coalesce(known, by_id)
    raw = (
        F.when(found.isNotNull(), F.lit(None).cast("string"))
        .when(named.isNotNull(), named)
        .when(event_id.isNotNull(), F.concat(F.lit("EventID:"), event_id.cast("string")))
        .otherwise(F.lit("unclassified"))
    )
    return F.struct(F.coalesce(found, F.lit("unknown")).alias("event_type"), raw.alias("event_type_raw"))


def classify_severity(named: Column, level: Column) -> Column:
    by_name = _lookup({s.lower(): s for s in SEVERITIES}, F.lower(named))
    by_level = _lookup(NUMERIC_LEVELS, level)
    return F.coalesce(F.when(named.isNotNull(), by_name).otherwise(by_level), F.lit("Info"))


def extract_timestamp(fields: Column) -> Column:
    """First RFC 3339 text among the timestamp keys; null when there is none."""
    def parsed(key):
        text = _string_field(fields, key)
        return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.upper(text)))

    return F.coalesce(*[parsed(k) for k in TIMESTAMP_KEYS])


# --- aliases and columns ---------------------------------------------------------------


def _aliases(extended: bool) -> dict[str, list[str]]:
    extra = EXTENDED_ALIASES if extended else {}
    return {c: names + extra.get(c, []) for c, names in FIELD_ALIASES.items()}


def apply_aliases(metadata: Column, extended: bool = False) -> Column:
    """Add canonical keys that are absent from the first alias that is present."""
    pairs = []
    for canonical, names in _aliases(extended).items():
        pairs += [F.lit(canonical), F.coalesce(*[metadata[n] for n in names])]
    missing = F.map_filter(
        F.create_map(*pairs), lambda k, v: v.isNotNull() & ~F.map_contains_key(metadata, k)
    )
    return F.map_concat(metadata, missing)


def canonical_columns(events: DataFrame) -> DataFrame:
    """Order and complete the event columns; ``us`` and the severity rank are derived."""
    events = events.withColumns(
        {"us": F.unix_micros("ts"), "severity_rank": severity_rank(F.col("severity"))}
    )
    return events.select(*EVENT_SCHEMA.names)


def host_filter(events: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """Keep events of these hosts, case-insensitively; an empty list keeps all."""
    if not hosts:
        return events
    return events.where(F.lower(F.coalesce(F.col("host"), F.lit(""))).isin(*[h.lower() for h in hosts]))


def normalize(
    raw: DataFrame,
    *,
    hosts: Sequence[str] = (),
    extended_aliases: bool = False,
    numeric_level_text: bool = False,
) -> DataFrame:
    """Raw records (``source``, ``raw``, ``received_at``, ``seq``) to canonical events.

    ``numeric_level_text`` lets a level given as text count, as exported Windows records have
    it; ``extended_aliases`` knows the lower-cased Windows names. Both are off by default.
    Event ids come from source, content and arrival number, or from ``occurrence`` in its place
    where ``number_repeats`` has added it.
    """
    record = F.col("raw")
    place = F.col("occurrence" if "occurrence" in raw.columns else "seq")
    parsed = raw.select(
        "source", "seq", "received_at", "raw", place.cast("string").alias("_place"),
        typed_fields(record).alias("_typed"), json_object(record).alias("_top"),
    )
    parsed = with_flat_map(parsed, "raw", "_top", "_flat")
    typed, top = F.col("_typed"), F.col("_top")
    level = _unsigned_field(typed, top, "Level")
    if numeric_level_text:
        level = parse_u64(top["Level"])
    staged = parsed.select(
        "source",
        "seq",
        F.sha2(
            F.concat_ws("|", F.col("source.kind"), F.col("source.name"), "_place", "raw"), 256
        ).alias("event_id"),
        F.coalesce(extract_timestamp(typed), F.col("received_at")).alias("ts"),
        classify_type(_string_field(typed, "event_type"), _unsigned_field(typed, top, "EventID")).alias("_type"),
        classify_severity(_string_field(typed, "severity"), level).alias("severity"),
        apply_aliases(F.col("_flat"), extended_aliases).alias("metadata"),
    )
    events = staged.select(
        "event_id", "seq", "ts", "source", "_type.*", "severity", "metadata",
        *[F.col("metadata")[name].alias(name) for name in PROMOTED],
    )
    return host_filter(canonical_columns(events), hosts)


