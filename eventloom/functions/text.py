"""Literal text matching on columns: no LIKE and no regular expression, because the
patterns themselves hold backslashes, dots, underscores and brackets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..fixed_values import PRIVATE_PREFIXES

U64_MAX = 18446744073709551615


def word_array(words) -> Column:
    """The list as an array that the optimizer folds to a literal; cheap to build at any length."""
    return F.split(F.lit("\n".join(words)), "\n")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def lowered(column: Column) -> Column:
    """Lower-cased text; missing text is empty."""
    return F.lower(F.coalesce(column, F.lit("")))


def _any_word(text: Column, words, test) -> Column:
    """Does the test hold for any word? The text is bound first, so that it is computed once
    however long the list; short lists are plain ORs, long ones stay small in generated code."""
    if len(words) <= 6:
        return any_of(test(text, F.lit(w)) for w in words)
    return F.exists(F.array(text), lambda t: F.exists(word_array(words), lambda w: test(t, w)))


def contains_any(text: Column, words) -> Column:
    return _any_word(text, words, F.contains)


def contains_all(text: Column, words) -> Column:
    return all_of(text.contains(F.lit(w)) for w in words)


def ends_with_any(text: Column, suffixes) -> Column:
    return _any_word(text, suffixes, F.endswith)


def starts_with_any(text: Column, prefixes) -> Column:
    return _any_word(text, prefixes, F.startswith)


def _matches(text: Column, words) -> Column:
    found = F.transform(F.array(text), lambda t: F.filter(word_array(words), lambda w: F.contains(t, w)))
    return F.get(found, F.lit(0))


def first_match(text: Column, words) -> Column:
    """The first word in list order that occurs in the text, else null."""
    return F.get(_matches(text, words), F.lit(0))


def all_matches(text: Column, words, separator: str = ", ") -> Column:
    return F.array_join(_matches(text, words), separator)


def is_private_ip(ip: Column) -> Column:
    octet = F.split(ip, "\\.", 3)
    second = F.get(octet, F.lit(1))
    in_172 = (
        F.startswith(ip, F.lit("172."))
        & second.rlike("^[+]?[0-9]+$")
        & second.try_cast("int").between(16, 31)
    )
    return starts_with_any(ip, PRIVATE_PREFIXES) | F.coalesce(in_172, F.lit(False))


def parse_u64(text: Column) -> Column:
    """Unsigned 64-bit parse as decimal(20,0); anything else is null."""
    number = F.when(text.rlike("^[+]?[0-9]+$"), text.try_cast("decimal(38,0)"))
    return F.when(number <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), number).cast("decimal(20,0)")


def line(*parts) -> Column:
    """One evidence line: literals and columns glued together. Columns must not be null."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def lines(*parts: Column) -> Column:
    """Evidence array; null lines are left out."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull())
