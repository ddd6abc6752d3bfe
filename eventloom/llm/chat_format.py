"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine walks a conversation's turns in order. Each step says whether the turn may follow and emits its segments
(text, loss): the opening mark, the escaped text and the closing mark; the loss flag comes from the role and the state.
After the first turn out of order the machine is astray and stays so: turns are still written, none is in order.
Texts are escaped so that no mark occurs inside them: a backslash doubles, and one goes behind the first character of
each mark. Reading back finds marks and takes the escapes out.

Turns are dealt by conversation and sorted by turn; a task walks them row by row and holds the rows of one conversation
only as far as its output row needs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Marks by role; other roles are written between the marks of ``other``. ``order`` maps a role to those that may follow."""

    opens: dict = field(default_factory=lambda: {"system": "<s>[SYS]", "user": "[INST]", "assistant": "[ANS]"})
    closes: dict = field(default_factory=lambda: {"system": "[/SYS]", "user": "[/INST]", "assistant": "[/ANS]</s>"})
    other: tuple = ("[ROLE]", "[/ROLE]", "[END]")
    loss_roles: tuple = ("assistant",)
    order: dict = field(default_factory=lambda: {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: Whether texts count for the loss from the first turn out of order on.
    loss_astray: bool = True

    def marks(self) -> list[str]:
        """All control strings, longest first; each starts with a character that stands nowhere else in a mark."""
        found = {p for m in [*self.opens.values(), *self.closes.values(), *self.other] for p in re.findall(r"<[^<>\[\]]*>|\[[^<>\[\]]*\]", m)}
        return sorted(found, key=lambda m: (-len(m), m))


#: The machine's states besides the roles, each of which is the state after a turn of that role in order.
START, ASTRAY = object(), object()


class Formatter:
    def __init__(self, template: Template):
        self.template = template
        marks = template.marks()
        if any("\\" in m or m[0] in m[1:] for m in marks):
            raise ValueError("a mark holds a backslash or repeats its first character")
        self.stop = re.compile("|".join(map(re.escape, marks)))
        self.danger = re.compile(r"\\|" + "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in marks))
        heads = sorted({*template.opens.values(), template.other[0]}, key=len, reverse=True)
        self.head = re.compile("|".join(map(re.escape, heads)))
        self.role_of = {m: r for r, m in template.opens.items()}

    def escape(self, text: str) -> str:
        return self.danger.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def step(self, state: object, role: str | None) -> tuple[object, tuple[str, str, bool]]:
        """From a state on a role: the next state, and what the turn is written with (opening mark, closing mark, loss)."""
        t = self.template
        follows = () if state is ASTRAY else t.order.get(None if state is START else state, ())
        after = role if role is not None and role in follows else ASTRAY
        # A null role is written as an empty name with one backslash, which no escaped name is.
        opening = t.opens.get(role) or t.other[0] + ("\\0" if role is None else self.escape(role)) + t.other[1]
        return after, (opening, t.closes.get(role, t.other[2]), role in t.loss_roles and (t.loss_astray or after is not ASTRAY))

    def walk(self, turns) -> Iterator[tuple[bool, list[tuple[str, bool]]]]:
        """For each (role, text) pair whether it is in order, and its segments (text, loss)."""
        state: object = START
        for role, text in turns:
            state, (opening, closing, loss) = self.step(state, role)
            yield state is not ASTRAY, [(opening, False), (self.escape(text), loss), (closing, False)]

    def written(self, turns) -> tuple[list[tuple[str, bool]], int]:
        """The segments of all turns, and the place of the first turn out of order, or -1."""
        segments: list[tuple[str, bool]] = []
        bad = -1
        for at, (fits, own) in enumerate(self.walk(turns)):
            segments += own
            if bad < 0 and not fits:
                bad = at
        return segments, bad

    def read(self, text: str) -> list[tuple[str | None, str]]:
        """The turns of a formatted conversation."""
        turns, at = [], 0
        while at < len(text):
            head = self.head.match(text, at)
            if not head:
                raise ValueError(f"no turn starts at {at}")
            at = head.end()
            role, close = self.role_of.get(head[0]), self.template.closes.get(self.role_of.get(head[0]))
            if close is None:
                close = self.template.other[2]
                end = text.index(self.template.other[1], at)
                role = None if text[at:end] == "\\0" else self.unescape(text[at:end])
                at = end + len(self.template.other[1])
            end = self.stop.search(text, at).start()
            if not text.startswith(close, end):
                raise ValueError(f"a turn is not closed at {end}")
            turns.append((role, self.unescape(text[at:end])))
            at = end + len(close)
        return turns


_SCHEMA = "conv_id long, formatted string, segments array<struct<text:string,loss:boolean>>, bad_turn int"


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments, bad_turn (first turn out of order by the machine, else -1).

    Null text counts as empty, a null role is kept as null and out of order; rows without an id make one conversation.
    Turns are ordered by turn (null last), then role and text, so that ties and repeated rows have a fixed place.
    Conversations out of order are formatted like the others; the template's loss_astray says whether their texts count
    for the loss from the bad turn on.
    """
    formatter = Formatter(template or Template())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        held_id: object = None
        ready: list[tuple] = []

        def close():
            segments, bad = formatter.written(held)
            ready.append((held_id, "".join(s for s, _ in segments), [{"text": s, "loss": f} for s, f in segments], bad))

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(ready, columns=["conv_id", "formatted", "segments", "bad_turn"])
            ready.clear()
            return out.astype({"conv_id": "Int64"})

        for batch in batches:
            for conv, role, text in zip(batch["conv_id"].astype("Int64"), batch["role"], batch["content"]):
                conv = None if conv is pd.NA else int(conv)
                if held and conv != held_id:
                    close()
                    held.clear()
                held_id = conv
                held.append((role if isinstance(role, str) else None, text))
            yield frame()
        if held:
            close()
            yield frame()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), "content")
    return dealt.select("conv_id", "role", "content").mapInPandas(run, _SCHEMA)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """From the formatted text and its segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, bad_turn."""
    formatter = Formatter(template or Template())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, text, segments, bad in zip(batch["conv_id"].astype("Int64"), batch["formatted"], batch["segments"], batch["bad_turn"]):
                turns = formatter.read(text)
                loss = "".join(formatter.unescape(s["text"]) for s in segments if s["loss"])
                whole = "".join(f"{r or ''}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text), bad))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "bad_turn"]).astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "formatted", "segments", "bad_turn").mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, bad_turn int"
    )
