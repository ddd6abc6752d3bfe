"""Rules written by the caller.

Rules about one event are ``StatelessRule``; rules about counts, sums and distinct values in
the window are ``LevelRule``; both stay columns. For the rest there are Python functions, run on Arrow batches per key and
time bucket: ``batch_rule`` gives a function whole arrays with the bounds of every event's window, ``context_rule`` is the
convenient form that is called once per event.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.context import slice_of, window_micros
from .rules import FrameRule

FOUND = "seq bigint, us bigint, host string, severity string, event_ids array<string>, evidence array<string>"


@dataclass(frozen=True)
class Windows:
    """Events of one key in the order of time, and for each asked event ``rows[at]`` its context ``rows[first:at + 1]``."""

    rows: pd.DataFrame
    at: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return self.at + 1 - self.first

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per event over each context; exact for whole numbers."""
        running = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
        return running[self.at + 1] - running[self.first]


Found = tuple[np.ndarray, Sequence[str], Sequence[list[str]]]
BatchEvaluate = Callable[[Windows], Found]
Evaluate = Callable[[dict, pd.DataFrame], tuple[str, list[str]] | None]


def batch_rule(
    rule_id: str,
    name: str,
    evaluate: BatchEvaluate,
    *,
    keys: Sequence[str],
    columns: Sequence[str],
    types: Sequence[str] = (),
    bucket_secs: float | None = None,
    description: str = "",
    tags: Sequence[str] = (),
    window_secs: float | None = None,
) -> FrameRule:
    """``evaluate(windows)`` returns which of the asked events fire (places in ``windows.at``), their severities and their
    evidence lists. It is called once per (keys, time bucket), whatever number of events that holds.

    A group holds its bucket and the window before it, copied from as many earlier buckets as the window reaches over. With
    ``bucket_secs`` below the window a busy key is spread over more tasks, and each row is copied about window / bucket
    times; by default a bucket is as long as the window.
    """
    wanted = list(dict.fromkeys(["event_id", "seq", "us", "host", "event_type", *keys, *columns]))

    def find(events: DataFrame, window: float) -> DataFrame:
        window_us = window_micros(window)
        bucket_us = max(1, window_us if bucket_secs is None else window_micros(bucket_secs))
        if types:
            events = events.where(F.col("event_type").isin(*types))
        home = slice_of(F.col("us"), bucket_us)
        last = slice_of(F.col("us") + F.lit(window_us), bucket_us)
        rows = (
            events.select(*wanted)
            .dropna(subset=list(keys))
            .select("*", home.alias("_home"), F.explode(F.sequence(home, last)).alias("_bucket"))
        )

        def objects(values: Sequence, hits: pd.DataFrame) -> pd.Series:
            return pd.Series(list(values), index=hits.index, dtype=object)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["us", "seq"], ignore_index=True)
            at = np.flatnonzero((pdf["_home"] == pdf["_bucket"]).to_numpy())
            us = pdf["us"].to_numpy()
            first = np.searchsorted(us, us[at] - window_us, side="left")
            fired, severities, evidence = evaluate(Windows(pdf.drop(columns=["_home", "_bucket"]), at, first)) if len(at) else ([], [], [])
            hits = pdf.iloc[at[np.asarray(fired, dtype=int)]]
            return hits[["seq", "us", "host"]].assign(
                severity=objects(severities, hits),
                event_ids=objects([[i] for i in hits["event_id"]], hits),
                evidence=objects([list(e) for e in evidence], hits),
            )

        return rows.groupBy(*keys, "_bucket").applyInPandas(run, FOUND)

    return FrameRule(
        rule_id=rule_id, name=name, description=description, tags=tuple(tags), find=find, window_secs=window_secs
    )


def context_rule(rule_id: str, name: str, evaluate: Evaluate, **options) -> FrameRule:
    """``evaluate(event, context)`` returns ``(severity, evidence)`` or None; one call per event, so prefer ``batch_rule``
    for events in great number. The context holds the events of the same keys in the trailing window, the event last.
    ``options`` are those of ``batch_rule``."""

    def each(windows: Windows) -> Found:
        found = []
        for place, (at, first) in enumerate(zip(windows.at, windows.first)):
            context = windows.rows.iloc[first : at + 1]
            result = evaluate(context.iloc[-1].to_dict(), context)
            if result is not None:
                found.append((place, *result))
        return np.array([f[0] for f in found], dtype=int), [f[1] for f in found], [f[2] for f in found]

    return batch_rule(rule_id, name, each, **options)
