"""Sigma rules. Each rule is compiled to one boolean column on the driver, so any number of
rules run in the same stateless pass as the built-in ones.

By default syntax outside the supported subset (parentheses, trailing words, ``not 1 of``) is
refused; ``compat=True`` reads it the lenient way: parentheses belong to names, words after a
complete condition are ignored, and ``not`` takes the next word as a name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import EVENT_TYPES, SIGMA_LEVELS, SIGMA_LOGSOURCES
from ..functions.text import all_of, any_of, line, lines, lowered
from ..schema import PROMOTED
from .rule_index import RuleIndex
from .rules import Branch, RuleSet, StatelessRule

MODIFIERS = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}
DEFAULT_ID_BYTES = 20


class SigmaError(ValueError):
    """A rule that cannot be used, with the reason."""


def parse_yaml(text: str) -> object:
    """YAML with the core scalar types only: words like yes or dates stay text."""
    try:
        import yaml
    except ImportError:  # JSON is a subset of YAML
        return json.loads(text)

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {}

    for tag, pattern, firsts in (
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("int", r"^[-+]?[0-9]+$", "-+0123456789"),
        ("float", r"^[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$", "-+.0123456789"),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(firsts))
    return yaml.load(text, Loader)  # noqa: S506 - a SafeLoader


def _required(value, kind, what):
    if not isinstance(value, kind):
        raise SigmaError(f"{what} is missing or has the wrong type")
    return value


def _optional(value, kind, what):
    return value if value is None else _required(value, kind, what)


# --- field matchers --------------------------------------------------------------------


def _texts(value) -> list[str]:
    if isinstance(value, bool):
        return [str(value).lower()]
    if isinstance(value, (str, int, float)):
        return [str(value)]
    if isinstance(value, list):
        return [text for item in value for text in _texts(item)]
    return []


def field_value(name: str, case_insensitive: bool = False) -> Column:
    """Lower-cased text of a metadata field; a missing field is empty text.

    Rules name fields in lower case while stored keys keep theirs, so ``CommandLine`` finds
    nothing unless ``case_insensitive`` is set.
    """
    stored = F.col("metadata")[name]
    if case_insensitive:
        same = F.filter(F.map_entries("metadata"), lambda e: F.lower(e["key"]) == name)
        stored = F.coalesce(stored, F.get(same, F.lit(0))["value"])
    if name in PROMOTED:
        stored = F.coalesce(F.col(name), stored)
    return lowered(stored)


def _matcher(key: str, value, case_insensitive: bool) -> Column:
    name, _, modifier = key.partition("|")
    text = field_value(name.lower(), case_insensitive)
    words = [w.lower() for w in _texts(value)]
    test = MODIFIERS.get(modifier)
    if test is None:
        return text.isin(*words) if words else F.lit(False)
    return any_of(test(text, F.lit(w)) for w in words)


def _selection(name: str, fields, case_insensitive: bool) -> Column:
    fields = _required(fields, Mapping, f"set '{name}'")
    return all_of(_matcher(_required(k, str, "field name"), v, case_insensitive) for k, v in fields.items())


# --- condition -------------------------------------------------------------------------


def condition_terms(text: str, names: Iterable[str], compat: bool = False) -> list[list[tuple[str, list[str]]]]:
    """Alternatives joined by ``or``, each a list of terms joined by ``and``: ("any" or "all" or
    "not", set names). A term is a set name, ``not`` name, ``1 of`` prefix or ``all of`` prefix;
    names that no set has are left out, and "any" and "all" of nothing are false."""
    words = text.split()
    names = list(names)
    if not compat and any(c in text for c in "()|"):
        raise SigmaError(f"unsupported syntax in condition: {text}")
    at = 0

    def word(offset=0):
        return words[at + offset].lower() if at + offset < len(words) else None

    def named():
        if at >= len(words):
            raise SigmaError(f"condition ends too early: {text}")
        return words[at]

    alternatives, together = [], []
    while True:
        if word() == "not":
            at += 1
            name = named()
            if not compat and name.lower() in ("not", "1", "all") and name not in names:
                raise SigmaError(f"unsupported syntax in condition: {text}")
            together.append(("not", [n for n in names if n == name]))
        elif word() in ("1", "all") and word(1) == "of":
            kind = "any" if word() == "1" else "all"
            at += 2
            prefix = named().rstrip("*")
            chosen = [n for n in names if n.startswith(prefix)]
            if not compat and prefix == "them" and not chosen:
                raise SigmaError(f"unsupported syntax in condition: {text}")
            together.append((kind, chosen))
        else:
            together.append(("any", [n for n in names if n == named()]))
        at += 1
        joined_by = word()
        if joined_by == "and":
            at += 1
            continue
        alternatives.append(together)
        together = []
        if joined_by != "or":
            break
        at += 1
    if at < len(words) and not compat:
        raise SigmaError(f"words after the end of the condition: {text}")
    return alternatives


def compile_condition(text: str, sets: Mapping[str, Column], compat: bool = False) -> Column:
    """A condition over the sets' columns."""

    def term(kind, chosen):
        columns = [sets[n] for n in chosen]
        if kind == "not":
            return ~columns[0] if columns else F.lit(True)
        return (any_of(columns) if kind == "any" else all_of(columns)) if columns else F.lit(False)

    return any_of(all_of(term(*t) for t in together) for together in condition_terms(text, sets, compat))


# --- rules -----------------------------------------------------------------------------


def _type_label() -> Column:
    """Event type as evidence shows it: CamelCase names, unknown ones quoted."""
    label = F.lit(None).cast("string")
    for name in EVENT_TYPES:
        label = F.when(F.col("event_type") == name, F.lit(name.title().replace("_", ""))).otherwise(label)
    raw = F.coalesce(F.col("event_type_raw"), F.lit(""))
    quoted = F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.coalesce(label, F.concat(F.lit('Unknown("'), quoted, F.lit('")')))


def read_rule(source: str | Mapping) -> dict:
    """The parts of a rule, from YAML text or an already parsed mapping, with all checks but that of the condition."""
    rule = _required(parse_yaml(source) if isinstance(source, str) else source, Mapping, "rule")
    title = _required(rule.get("title"), str, "title")
    logsource = _required(rule.get("logsource"), Mapping, "logsource")
    detection = _required(rule.get("detection"), Mapping, "detection")
    condition = _required(detection.get("condition"), str, "condition")
    level = _optional(rule.get("level"), str, "level")
    tags = _optional(rule.get("tags"), list, "tags") or []
    category = _optional(logsource.get("category"), str, "category")
    service = _optional(logsource.get("service"), str, "service")
    event_type = SIGMA_LOGSOURCES.get(category if category is not None else service)
    short = title.encode()[:DEFAULT_ID_BYTES].decode(errors="ignore")
    rule_id = _optional(rule.get("id"), str, "id")
    sets = {n: _required(f, Mapping, f"set '{n}'") for n, f in detection.items() if n not in ("condition", "timeframe")}
    for fields in sets.values():
        for key in fields:
            _required(key, str, "field name")
    return {
        "rule_id": rule_id if rule_id is not None else f"SIGMA-{short}",
        "title": title,
        "description": _optional(rule.get("description"), str, "description") or "",
        "tags": tuple(_required(t, str, "tag") for t in tags),
        "event_type": event_type,
        "severity": SIGMA_LEVELS.get(level, "Info"),
        "condition": condition,
        "sets": sets,
    }


def compile_rule(source: str | Mapping, *, compat: bool = False, case_insensitive_fields: bool = False) -> StatelessRule:
    """One rule, from YAML text or an already parsed mapping."""
    rule = read_rule(source)
    sets = {name: _selection(name, fields, case_insensitive_fields) for name, fields in rule["sets"].items()}
    title = rule["title"]
    return StatelessRule(
        rule_id=rule["rule_id"],
        name=title,
        description=rule["description"],
        tags=rule["tags"],
        types=(rule["event_type"],) if rule["event_type"] else (),
        branches=(
            Branch(
                compile_condition(rule["condition"], sets, compat),
                rule["severity"],
                lines(line(f"Sigma rule '{title}' matched on ", _type_label())),
            ),
        ),
    )


def load_rules(
    paths: Iterable[str] = (), texts: Sequence[str | Mapping] = (), *, strict: bool = False, **options
) -> RuleSet:
    """Rules from files and texts. A rule that does not load is listed in ``errors`` and
    skipped; with ``strict`` it raises."""
    rules = RuleSet([])
    sources = [(str(p), None) for p in paths] + [(f"text {i}", t) for i, t in enumerate(texts)]
    for name, source in sources:
        try:
            rules.rules.append(compile_rule(Path(name).read_text() if source is None else source, **options))
        except Exception as error:
            if strict:
                raise
            rules.errors[name] = str(error)
    return rules


# --- rules as data ---------------------------------------------------------------------

def rule_data(rules: Iterable[Mapping], errors: dict[str, str] | None = None) -> tuple[dict[str, list], list[dict]]:
    """Rules as data: the tests of each field, and rules whose sets name tests by number.

    A rule that does not load is listed in ``errors`` and skipped; without such a table it raises.
    """
    tests: dict[str, list] = {}
    rows, numbers = [], {}
    for place, rule in enumerate(rules):
        try:
            head = read_rule(rule)  # the checks of a compiled rule, without its columns
            sets = list(head["sets"].items())
            order = {name: i for i, (name, _) in enumerate(sets)}
            alternatives = []
            for together in condition_terms(head["condition"], order):
                groups, never = [], []
                for kind, chosen in together:
                    places = [order[n] for n in chosen]
                    if kind == "not":
                        never += places
                    else:
                        groups += [[p] for p in places] if kind == "all" and places else [places]
                alternatives.append({"any": groups, "no": never})
            placed = []
            for name, fields in sets:
                own = []
                for key, value in fields.items():
                    field, _, modifier = key.lower().partition("|")
                    modifier = modifier if modifier in MODIFIERS else "exact"
                    texts = tuple(t.lower() for t in _texts(value))
                    matcher = numbers.get((field, modifier, texts))
                    if matcher is None:
                        matcher = numbers[field, modifier, texts] = len(numbers)
                        tests.setdefault(field, []).extend({"modifier": modifier, "value": x, "matcher": matcher} for x in texts)
                    own.append(matcher)
                placed.append({"at": order[name], "matchers": own})
        except Exception as error:
            if errors is None:
                raise
            errors[str(rule.get("id") or rule.get("title") or f"rule {place}") if isinstance(rule, Mapping) else f"rule {place}"] = str(error)
            continue
        rows.append({
            "rule_id": head["rule_id"], "severity": head["severity"], "event_type": head["event_type"],
            "sets": placed, "alternatives": alternatives,
        })
    return tests, rows


def match_rule_table(events: DataFrame, rules: Sequence[Mapping], errors: dict[str, str] | None = None) -> DataFrame:
    """Rules as data instead of columns, for thousands of them: ``rule_id``, ``seq``, ``severity``.

    Events pass in Arrow batches with the texts of the fields that rules name. Each task builds the index of all rules
    once, and an event only touches rules that share a word with it: no join, no shuffle, one output row per firing.
    """
    tests, rows = rule_data(rules, errors)
    fields = [field_value(name) for name in tests]
    texts = F.array(*fields) if fields else F.array().cast("array<string>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = RuleIndex(tests, rows)
        for batch in batches:
            out, known = [], {}
            for seq, kind, words in zip(batch["seq"], batch["event_type"], batch["texts"]):
                look = kind, tuple(words)
                if look not in known:  # equal texts are frequent in a batch
                    known[look] = index.fired(*look)
                out += [(rows[n]["rule_id"], seq, rows[n]["severity"]) for n in known[look]]
            yield pd.DataFrame(out, columns=["rule_id", "seq", "severity"])

    return events.select("seq", "event_type", texts.alias("texts")).mapInPandas(run, "rule_id string, seq bigint, severity string")
