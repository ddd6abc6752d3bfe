"""Thousands of rules at once: an index from the words in an event's fields to the rules that hold them.

The words of all rules that look at a field go into one Aho-Corasick automaton. A text is read once, whatever the number
of words, and gives the tests that hold; tests lead to matchers, complete matchers to sets, and sets to the rules that
name them. So an event costs what its text is long and what rules share a word with it. Rules that can fire without any
of their sets (``not`` alone, sets without tests) are looked at for every event.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

import ahocorasick

HOLDS = {
    "contains": lambda start, end, size: True,
    "startswith": lambda start, end, size: start == 0,
    "endswith": lambda start, end, size: end == size,
    "exact": lambda start, end, size: start == 0 and end == size,
}


class WordIndex:
    """The matchers of one field, from its tests (modifier, value, matcher)."""

    def __init__(self, tests: Sequence[Mapping]):
        self.automaton, self.always, self.blank = ahocorasick.Automaton(), set(), set()
        words = defaultdict(list)
        for test in tests:
            words[test["value"]].append((HOLDS[test["modifier"]], test["matcher"]))
            if test["value"] == "":  # every text contains, begins and ends with it; only an empty one equals it
                (self.blank if test["modifier"] == "exact" else self.always).add(test["matcher"])
        words.pop("", None)
        for word, held in words.items():
            self.automaton.add_word(word, (len(word), held))
        self.any = bool(words)
        if self.any:
            self.automaton.make_automaton()

    def matchers(self, text: str) -> set[int]:
        """Numbers of the matchers that hold for the (lower-cased) text."""
        found = set(self.always) if text else self.always | self.blank
        if self.any:
            size = len(text)
            for last, (length, held) in self.automaton.iter(text):
                start = last + 1 - length
                found.update(matcher for holds, matcher in held if holds(start, last + 1, size))
        return found


class RuleIndex:
    """All rules, from ``sigma.rule_data``: the tests of each field and the rules by number."""

    def __init__(self, tests: Mapping[str, Sequence[Mapping]], rules: Sequence[Mapping]):
        self.fields = [WordIndex(known) for known in tests.values()]
        self.rules = rules
        self.needed: dict[tuple[int, int], int] = {}  # (rule, set): number of its matchers
        self.of_matcher: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.free: list[int] = []
        for number, rule in enumerate(rules):
            for s in rule["sets"]:
                own = set(s["matchers"])
                self.needed[number, s["at"]] = len(own)
                for matcher in own:
                    self.of_matcher[matcher].append((number, s["at"]))
            empty = {s["at"] for s in rule["sets"] if not s["matchers"]}
            if empty or any(not a["any"] for a in rule["alternatives"]):
                self.free.append(number)
        self.empty = {number: {s["at"] for s in rules[number]["sets"] if not s["matchers"]} for number in self.free}

    def candidates(self, texts: Sequence[str]) -> dict[int, set[int]]:
        """The rules with a set that holds for the texts (one per field), and those that need none: rule to its sets."""
        missing: dict[tuple[int, int], int] = {}
        held: dict[int, set[int]] = {number: set(self.empty[number]) for number in self.free}
        for index, text in zip(self.fields, texts):
            for matcher in index.matchers(text):
                for place in self.of_matcher[matcher]:
                    left = missing.get(place, self.needed[place]) - 1
                    missing[place] = left
                    if not left:
                        held.setdefault(place[0], set()).add(place[1])
        return held

    def fired(self, event_type: str | None, texts: Sequence[str]) -> list[int]:
        """Numbers of the rules that fire."""
        out = []
        for number, sets in self.candidates(texts).items():
            rule = self.rules[number]
            if rule["event_type"] is None or rule["event_type"] == event_type:
                if any(all(not sets.isdisjoint(g) for g in a["any"]) and sets.isdisjoint(a["no"]) for a in rule["alternatives"]):
                    out.append(number)
        return sorted(out)
