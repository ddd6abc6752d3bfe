"""Rule fan-out: every rule over every event, in a few shared passes.

* all stateless rules: one projection over the events, no shuffle;
* all level rules: one sweep, whatever their keys and measures, because the rule number is
  part of the key;
* frame rules: one plan each.

Arrays are exploded in their outer form and nulls dropped afterwards. The plain form would
make the optimizer infer a "not empty" filter and push it below the projection, which
evaluates every rule twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import DEFAULT_WINDOW_SECS, RULE_HEADS
from ..functions.text import lowered
from ..operators.context import presence_deltas, running_levels, slice_micros, sweep, window_micros
from ..schema import DETECTION_COLUMNS, severity_weight
from .builtin import builtin_rules
from .rules import FrameRule, LevelRule, Rule, RuleSet, StatelessRule

AMOUNT = "decimal(20,0)"
HEADS = "array<struct<rule_id:string,rule_name:string,description:string,tags:array<string>>>"
KEYS = ["_rule", "_k1", "_k2"]


def rule_set(
    sigma: RuleSet | None = None, extra: Iterable[Rule] = (), disabled: Sequence[str] = ()
) -> RuleSet:
    """Built-in rules, then Sigma rules, then the caller's, without the disabled ones."""
    sigma = RuleSet([]) if sigma is None else sigma
    return RuleSet([*builtin_rules(), *sigma, *extra], dict(sigma.errors)).without(disabled)


def needed_types(rules) -> list[str] | None:
    """Event types the rules need; None when one of them takes any type."""
    if any(not r.types for r in rules):
        return None
    return sorted({t for r in rules for t in r.types})


def only_types(events: DataFrame, types) -> DataFrame:
    return events if types is None else events.where(F.col("event_type").isin(*types))


def fired_rows(rules: Sequence[Rule], frame: DataFrame, index: Column) -> DataFrame:
    """Attach what is the same for every firing of a rule, from a constant array by rule number."""
    heads = F.from_json(
        F.lit(
            json.dumps(
                [
                    {"rule_id": r.rule_id, "rule_name": r.name, "description": r.description, "tags": list(r.tags)}
                    for r in rules
                ]
            )
        ),
        HEADS,
    )
    return frame.withColumn("_head", F.get(heads, index)).select(
        F.col("_head")["rule_id"].alias("rule_id"),
        F.col("_head")["rule_name"].alias("rule_name"),
        F.col("_head")["description"].alias("description"),
        "severity",
        "event_ids",
        F.col("seq").alias("trigger_seq"),
        F.timestamp_micros("us").alias("event_ts"),
        "host",
        F.col("_head")["tags"].alias("tags"),
        "evidence",
    )


def stateless_detections(events: DataFrame, rules: Sequence[StatelessRule]) -> DataFrame:
    """All stateless rules in one projection; rules that need the same event types share a guard."""
    groups: dict[tuple[str, ...], list[Column]] = {}
    for index, rule in enumerate(rules):
        outcome = F.lit(None)
        for branch in reversed(rule.branches):
            hit = F.struct(
                F.lit(index).alias("_rule"),
                F.lit(branch.severity).alias("severity"),
                branch.evidence.alias("evidence"),
            )
            outcome = F.when(branch.when, hit).otherwise(outcome)
        groups.setdefault(tuple(rule.types), []).append(outcome)
    parts = [
        F.when(F.col("event_type").isin(*types) if types else F.lit(True), F.array_compact(F.array(*outcomes)))
        for types, outcomes in groups.items()
    ]
    hits = F.flatten(F.array_compact(F.array(*parts)))
    prepared = only_types(events, needed_types(rules)).withColumn("_cmd", lowered(F.col("cmd")))
    found = (
        prepared.select("seq", "us", "host", "event_id", hits.alias("_hits"))
        .select("seq", "us", "host", "event_id", F.explode_outer("_hits").alias("_hit"))
        .where("_hit is not null")
        .select("seq", "us", "host", F.array("event_id").alias("event_ids"), "_hit.*")
    )
    return fired_rows(rules, found, F.col("_rule"))


def _key_struct(index: int, rule: LevelRule) -> dict[str, Column]:
    keys = [k.cast("string") for k in rule.keys] + [F.lit("")] * (2 - len(rule.keys))
    return {"_rule": F.lit(index), "_k1": keys[0], "_k2": keys[1]}


def _keys_present(rule: LevelRule) -> Column:
    return reduce(lambda a, k: a & k.isNotNull(), rule.keys, F.lit(True))


WindowOf = Callable[[LevelRule], int]


def level_deltas(events: DataFrame, rules: Sequence[LevelRule], window_us: WindowOf) -> DataFrame:
    """The rows of the sweep of all level rules but the sightings: what counts or sums, and what is asked."""
    events = only_types(events, needed_types(rules))
    # Conditions first, each computed once; then one struct per rule that applies.
    flags = {}
    for index, rule in enumerate(rules):
        present = _keys_present(rule)
        counted = rule.measure in ("count", "sum")
        flags[f"_m{index}"] = F.coalesce(rule.member & present, F.lit(False)) if counted else F.lit(False)
        flags[f"_e{index}"] = F.coalesce(
            rule.trigger if rule.null_key else rule.trigger & present, F.lit(False)
        )
    flagged = events.withColumns(flags)

    rows = []
    for index, rule in enumerate(rules):
        member, emit = F.col(f"_m{index}"), F.col(f"_e{index}")
        carried = F.array(*[c.cast("string") for c in rule.carry.values()])
        row = F.struct(
            *[c.alias(n) for n, c in _key_struct(index, rule).items()],
            member.alias("_member"),
            emit.alias("_emit"),
            F.lit(int(rule.measure in ("distinct", "present"))).alias("_probe"),
            F.lit(window_us(rule)).cast("bigint").alias("_window"),
            F.lit(int(rule.measure != "sum")).cast("bigint").alias("_n"),
            (rule.value if rule.measure == "sum" else F.lit(0)).cast(AMOUNT).alias("_amount"),
            F.when(emit, carried).alias("_carry"),
        )
        rows.append(F.when(member | emit, row))
    common = ["us", "seq", "event_id", "host"]
    exploded = (
        flagged.select(*common, F.array_compact(F.array(*rows)).alias("_rows"))
        .select(*common, F.explode_outer("_rows").alias("_row"))
        .where("_row is not null")
        .select("us", "seq", "_row.*", F.struct("event_id", "host", F.col("_row._carry").alias("carry")).alias("_keep"))
    )
    return sweep(exploded, KEYS, ["_n", "_amount"], F.col("_window"))


def level_sightings(events: DataFrame, rules: Sequence[LevelRule], window_us: WindowOf) -> dict[int, DataFrame]:
    """For each window length the sightings that distinct counts and presence tests are made of: the key and _value."""
    events = only_types(events, needed_types(rules))
    by_window: dict[int, list[Column]] = {}
    for index, rule in enumerate(rules):
        if rule.measure in ("distinct", "present"):
            value = rule.value if rule.measure == "distinct" else F.lit("")
            sighting = F.struct(
                *[c.alias(n) for n, c in _key_struct(index, rule).items()],
                value.cast("string").alias("_value"),
            )
            by_window.setdefault(window_us(rule), []).append(
                F.when(rule.member & _keys_present(rule) & value.isNotNull(), sighting)
            )
    return {
        length: events.select("us", "seq", F.array_compact(F.array(*sightings)).alias("_seen"))
        .select("us", "seq", F.inline_outer("_seen"))
        .where("_rule is not null")
        for length, sightings in by_window.items()
    }


def fired_levels(levels: DataFrame, rules: Sequence[LevelRule]) -> DataFrame:
    """Gates and evidence over the levels of the asked events."""
    fires, severity, evidence = F.lit(False), F.lit(None), F.lit(None)
    for index, rule in enumerate(rules):
        mine = F.col("_rule") == index
        carry = {name: F.get(F.col("_keep.carry"), F.lit(i)) for i, name in enumerate(rule.carry)}
        level = F.col("_amount") if rule.measure == "sum" else F.col("_n")
        fires = F.when(mine, rule.fires(level, carry)).otherwise(fires)
        severity = F.when(mine, F.lit(rule.severity)).otherwise(severity)
        evidence = F.when(mine, rule.evidence(level, carry)).otherwise(evidence)
    found = levels.where(fires).select(
        "_rule", "seq", "us", "_keep.host", F.array("_keep.event_id").alias("event_ids"),
        severity.alias("severity"), evidence.alias("evidence"),
    )
    return fired_rows(rules, found, F.col("_rule"))


def level_detections(
    events: DataFrame, rules: Sequence[LevelRule], window_secs: float, slice_secs: float | None = None
) -> DataFrame:
    """All level rules in one sweep keyed by (rule, key)."""

    def window_us(rule):
        return window_micros(rule.window_secs if rule.window_secs is not None else window_secs)

    slice_us = slice_micros(max(window_us(r) for r in rules), slice_secs)
    deltas = level_deltas(events, rules, window_us)
    for length, members in level_sightings(events, rules, window_us).items():
        edges = presence_deltas(members, KEYS, "_value", "_n", length, slice_us)
        deltas = deltas.unionByName(edges, allowMissingColumns=True)
    return fired_levels(running_levels(deltas, KEYS, ["_n", "_amount"], slice_us), rules)


def _usable(rule: Rule, build: Callable[[], DataFrame], errors: dict[str, str] | None) -> DataFrame | None:
    """A caller's rule whose plan cannot be built is recorded and skipped; the others go on. Without a table that the caller
    can read it raises, and so does a Spark job that fails: that is no fault of the rule."""
    try:
        frame = build()
        frame.schema
        return frame
    except AnalysisException as error:
        failure = error
    except (PySparkException, Py4JError):
        raise
    except Exception as error:
        failure = error
    if errors is None:
        raise failure
    errors[rule.rule_id] = str(failure)
    return None


def finish(found: DataFrame, detected_at: Column | None = None) -> DataFrame:
    """Fired rules to detections: identity, time of detection and score."""
    now = F.current_timestamp() if detected_at is None else detected_at
    identity = F.sha2(F.concat_ws("|", F.col("rule_id"), F.col("event_ids")), 256)
    return found.withColumns(
        {
            "detection_id": identity,
            "detected_at": now,
            "score_contribution": severity_weight(F.col("severity")),
        }
    ).select(*DETECTION_COLUMNS)


def detect(
    events: DataFrame,
    rules: RuleSet | Sequence[Rule] | None = None,
    window_secs: float = DEFAULT_WINDOW_SECS,
    *,
    disabled: Sequence[str] = (),
    host_expr: Column | None = None,
    slice_secs: float | None = None,
    detected_at: Column | None = None,
    strict: bool = False,
) -> DataFrame:
    """Detections of all rules over normalised events, one row per firing.

    ``host_expr`` stands in for the host where events have none (packet tables); by default
    such events take no part in host-keyed rules. Caller rules whose plan is broken are listed in
    ``rules.errors`` of a RuleSet; with a plain list or ``strict`` they raise, as built-in rules
    always do.
    """
    errors = rules.errors if isinstance(rules, RuleSet) and not strict else None
    if not isinstance(rules, RuleSet):
        rules = RuleSet(builtin_rules() if rules is None else list(rules))
    active = rules.without(disabled)
    if host_expr is not None:
        events = events.withColumn("host", F.coalesce(F.col("host"), host_expr))

    parts = []
    builtin_ids = set(RULE_HEADS)

    def checked(kind, build):
        chosen = [r for r in active if isinstance(r, kind)]
        own = [r for r in chosen if r.rule_id in builtin_ids]
        foreign = [r for r in chosen if r.rule_id not in builtin_ids]
        good = own + [r for r in foreign if _usable(r, lambda r=r: build([r]), errors) is not None]
        if good:
            parts.append(build(good))

    checked(StatelessRule, lambda chosen: stateless_detections(events, chosen))
    checked(LevelRule, lambda chosen: level_detections(events, chosen, window_secs, slice_secs))
    for rule in active:
        if isinstance(rule, FrameRule):
            length = rule.window_secs if rule.window_secs is not None else window_secs
            plan = lambda rule=rule, length=length: fired_rows([rule], rule.find(events, length), F.lit(0))
            frame = plan() if rule.rule_id in builtin_ids else _usable(rule, plan, errors)
            if frame is not None:
                parts.append(frame)

    if not parts:
        raise ValueError("no usable rule")
    found = reduce(DataFrame.unionByName, parts)
    return finish(found, detected_at)
