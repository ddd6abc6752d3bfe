"""JSON that column expressions do not read: repeated keys and very deep objects, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T


LEVELS = 5  # nested levels that are columns; what lies deeper is lifted to the last one
MARK = "\x01"
ESCAPE = "\x02"
ESCAPES = {ESCAPE: ESCAPE + "b", MARK: ESCAPE + "a"}  # in this order; undone in the opposite one


class _Number(str):
    """A number as it is written."""


def _no_constant(word: str):
    raise ValueError(f"{word} is no JSON")


def _read(text: str):
    """One strict JSON value; of repeated keys the last one is kept."""
    return json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_no_constant)


def _write(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_write(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_write, value)) + "]"
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def _rewrite(text: str | None) -> str | None:
    try:
        if text is None:
            return None
        value = _read(text)
        return _write(dict(_lifted(None, value, LEVELS)) if isinstance(value, dict) else value)
    except (ValueError, RecursionError):
        return None


def _escaped(text: str) -> str:
    for char, code in ESCAPES.items():
        text = text.replace(char, code)
    return text


def _lifted(path: str | None, value: dict, room: int) -> Iterator[tuple[str, object]]:
    """Members of an object. Where no level is left, an object's leaves take its place: MARK path MARK last key, both
    escaped. A key that holds the mark itself is written in the same way there, without a path: MARK key."""
    for k, v in value.items():
        if isinstance(v, dict) and room > 0:
            yield k, dict(_lifted(None, v, room - 1))
        elif isinstance(v, dict):
            yield from _lifted(k if path is None else f"{path}.{k}", v, 0)
        elif path is not None:
            yield f"{MARK}{_escaped(path)}{MARK}{_escaped(k)}", v
        else:
            yield (MARK + _escaped(k) if room == 0 and MARK in k else k), v


@F.pandas_udf(T.StringType())
def rewritten_json(texts: pd.Series) -> pd.Series:
    """Valid JSON written anew: of repeated keys the last one, objects below LEVELS lifted; null for anything else."""
    return texts.map(_rewrite, na_action="ignore").astype(object)


# A filter on the result would otherwise be moved before the projection and parse every text a second time.
rewritten_json = rewritten_json.asNondeterministic()
