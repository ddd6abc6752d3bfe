"""Personal data: patterns propose spans, checksums and other validators confirm them, words nearby adjust the score.

The base kinds (email, ip, card, phone) always count once their own test holds; their score is raised or lowered by the
words around them but never drops them. The method's further kinds (iban, ssn, tel, routing, ipv6) count when validator
and context together reach the threshold. A further span that touches a base span or an earlier further one is left out.

Each text is read in time linear in its length: addresses are found from their @ outwards, and runs of digits are
matched whole. Null text is empty and has no spans; each row stands for itself, so repeated rows and missing identifiers
give rows of their own; an empty table gives none. Columns other than the two that are named play no part.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.common import batches_of_texts, text_or_empty

# The kinds in their order, and the base patterns with their limits.
BASE = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_PART = (14, 19), (10, 15), 255


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Every second digit from the right doubled, the digits' sum a multiple of ten."""
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def mod_97(code: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def routing_sum(number: str) -> bool:
    return sum(w * int(d) for w, d in zip((3, 7, 1) * 3, number)) % 10 == 0 and number != "0" * 9


def ssn_parts(text: str) -> bool:
    area, group, serial = text[:3], text[4:6], text[7:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def global_ipv6(text: str) -> bool:
    try:
        return ipaddress.IPv6Address(text).is_global and text.count(":") > 2
    except ValueError:
        return False


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: the local part is all of its characters since the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds in code points, by start, then kind as listed."""
    found = [(s, e, "email") for s, e in emails(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= IP_PART for p in (q.lstrip("0") or "0" for q in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0] and m.end() - m.start() < 2 * CARD_DIGITS[1]:
            number = digits(m[0])
            if CARD_DIGITS[0] <= len(number) <= CARD_DIGITS[1] and luhn(number):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(digits(m[0])) <= PHONE_DIGITS[1]]
    return sorted(found, key=lambda s: (s[0], BASE.index(s[2])))


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern (further kinds only), its test, the score of a valid span and the words that speak for it."""

    name: str
    score: float
    words: tuple[str, ...] = ()
    pattern: re.Pattern | None = None
    valid: Callable[[str], bool] | None = None


KINDS = (
    Kind("email", 0.9, ("mail", "contact", "kontakt", "correo", "courriel")),
    Kind("ip", 0.6, ("ip", "address", "host", "client", "login", "adresse")),
    Kind("card", 0.7, ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "cvv")),
    Kind("phone", 0.8, ("phone", "tel", "call", "fax", "mobile", "telefon", "teléfono", "téléphone")),
    Kind("iban", 0.9, ("iban", "account", "konto", "cuenta", "compte", "bank"), re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")),
    Kind("ssn", 0.4, ("ssn", "social", "security", "taxpayer"), re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), ssn_parts),
    Kind("tel", 0.3, ("phone", "tel", "call", "fax", "mobile", "telefon", "teléfono", "téléphone"), re.compile(r"(?<![0-9(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
    Kind("routing", 0.3, ("routing", "aba", "bank", "transfer"), re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])"), routing_sum),
    Kind("ipv6", 0.6, ("ip", "address", "host", "client", "login", "adresse"), re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])"), global_ipv6),
)
NAMES = tuple(k.name for k in KINDS)
AGAINST = ("example", "sample", "test", "dummy", "invoice", "order", "version", "isbn", "serial", "beispiel", "ejemplo", "exemple")
REACH, FOR, COUNTER, THRESHOLD = 60, 0.35, 0.25, 0.6
WORD = re.compile(r"[^\W\d_]+")


def _iban_end(text: str, start: int, end: int) -> int | None:
    """End of the longest prefix of the proposal that ends with a word and has remainder 1."""
    for stop in range(end, start + 14, -1):
        following = text[stop : stop + 1]
        if text[stop - 1] != " " and not (following.isascii() and following.isalnum()):
            code = text[start:stop].replace(" ", "")
            if 15 <= len(code) <= 34 and mod_97(code):
                return stop
    return None


def _ibans(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Confirmed proposals; a failing one gives way to what starts inside it."""
    m = pattern.search(text)
    while m:
        end = _iban_end(text, *m.span())
        if end is not None:
            yield m.start(), end
        m = pattern.search(text, m.start() + 4 if end is None else end)


def _proposed(text: str, kind: "Kind") -> Iterator[tuple[int, int]]:
    """Spans of a further kind that pass its validator."""
    if kind.name == "iban":
        return _ibans(text, kind.pattern)
    return (m.span() for m in kind.pattern.finditer(text) if kind.valid is None or kind.valid(m[0]))


def score(text: str, start: int, end: int, kind: Kind) -> float:
    """The kind's own score, raised once by words that speak for it and lowered once by words against it."""
    around = text[max(0, start - REACH) : start] + " " + text[end : end + REACH // 2]
    words = {w.lower() for w in WORD.findall(around)}
    out = kind.score + FOR * any(w in words for w in kind.words) - COUNTER * any(w in words for w in AGAINST)
    return min(1.0, max(0.0, out))


def find(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by start, then kind as listed; code points, end exclusive."""
    base = base_spans(text)
    out = [(kind, s, e, score(text, s, e, KINDS[NAMES.index(kind)]), True) for s, e, kind in base]
    for kind in KINDS[len(BASE) :]:
        # Of the spans so far: starts in order, and the furthest end up to each.
        places = sorted((s, e) for _, s, e, *_ in out)
        starts, ends = [s for s, _ in places], list(accumulate((e for _, e in places), max))
        for start, end in _proposed(text, kind):
            before = bisect_left(starts, end)
            if before and ends[before - 1] > start:
                continue
            value = score(text, start, end, kind)
            if value >= THRESHOLD:
                out.append((kind.name, start, end, value, False))
    return sorted(out, key=lambda s: (s[1], NAMES.index(s[0])))


SPANS = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the identifier and spans (kind, start, end, score, base) by start, then kind as listed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("kind", "start", "end", "score", "base")
        for batch in batches:
            texts = batch["content"].tolist()
            for at, end in batches_of_texts(batch["content"].str.len().to_numpy()):
                spans = [[dict(zip(names, s)) for s in find(t)] for t in texts[at:end]]
                yield pd.DataFrame({"id": batch["id"].iloc[at:end], "spans": spans})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("content"))
    kind = docs.schema[id_col].dataType
    found = rows.mapInPandas(run, f"id string, spans {SPANS}")
    return found.select(F.col("id").cast(kind).alias(id_col), "spans")


def count_of(kind: str, spans: str = "spans") -> Column:
    """Number of base spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the earlier start is named."""
    out, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; null texts stay null, other columns as they are."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact(t, find(t)))

    return docs.withColumn(text_col, clean(F.col(text_col)))
