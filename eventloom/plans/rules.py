"""Rule kinds. A rule is a declaration of columns; ``detect`` turns any number of rules into
a few shared passes over the events."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

PROCESS_LIKE = ("process_creation", "command_execution")


def of_type(*types: str) -> Column:
    return F.col("event_type").isin(*types)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    description: str = ""
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Branch:
    """When the condition holds the rule fires with this severity and evidence."""

    when: Column
    severity: str
    evidence: Column


@dataclass(frozen=True)
class StatelessRule(Rule):
    """Looks at one event. The first branch that holds decides; ``types`` empty means any type."""

    types: tuple[str, ...] = ()
    branches: tuple[Branch, ...] = ()


@dataclass(frozen=True)
class LevelRule(Rule):
    """Looks at a measure over the trailing context of its trigger.

    ``measure``: ``count`` of members, ``sum`` of ``value``, number of ``distinct`` values, or
    ``present`` (any member, 0 or 1). ``carry`` names the text columns that ``fires`` and
    ``evidence`` read besides the level. Triggers with a null key are skipped unless
    ``null_key`` is set; then their level is 0.
    """

    types: tuple[str, ...] = ()
    measure: str = "count"
    keys: tuple[Column, ...] = ()
    member: Column | None = None
    trigger: Column | None = None
    value: Column | None = None
    carry: Mapping[str, Column] = field(default_factory=dict)
    fires: Callable[[Column, Mapping[str, Column]], Column] = None
    evidence: Callable[[Column, Mapping[str, Column]], Column] = None
    severity: str = "High"
    null_key: bool = False
    window_secs: float | None = None


@dataclass(frozen=True)
class FrameRule(Rule):
    """Anything else: ``find(events, window_secs)`` returns ``seq``, ``us``, ``host``,
    ``severity``, ``event_ids`` and ``evidence``. It looks at most one window back and ahead of
    its triggers, and only at events of ``types`` if there are any."""

    types: tuple[str, ...] = ()
    find: Callable[[DataFrame, float], DataFrame] = None
    window_secs: float | None = None


@dataclass
class RuleSet:
    rules: list[Rule]
    errors: dict[str, str] = field(default_factory=dict)

    def without(self, disabled: Sequence[str]) -> "RuleSet":
        return RuleSet([r for r in self.rules if r.rule_id not in set(disabled)], dict(self.errors))

    def __iter__(self):
        return iter(self.rules)

    def __len__(self):
        return len(self.rules)
