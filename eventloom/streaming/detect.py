"""The same detections on a stream.

Stateless rules are the batch columns unchanged. Windowed measures and co-occurrence keep the
window in state, per key and time bucket: the events of a bucket plus those of the window
before it. A busy key therefore never owns one ever-growing state, and the state of a bucket is
dropped by a timer once the watermark is past it.

Late rows within the watermark delay see their own past; windows that were already answered are
not answered again. Rows later than the delay are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.context import slice_of, window_micros
from ..plans.detect import finish, stateless_detections
from ..plans.rules import StatelessRule

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_stateless(events: DataFrame, rules: Sequence[StatelessRule]) -> DataFrame:
    """Detections of stateless rules, append mode."""
    return finish(stateless_detections(events, rules))


def _copies(us: Column, bucket_us: int, before: int, after: int) -> Column:
    """Home bucket, and neighbouring buckets an event is visible from."""
    home = slice_of(us, bucket_us)
    return F.array(*[home + i for i in range(-before, after + 1)])


class _Bucketed(StatefulProcessor):
    """State rows per (key, bucket), dropped when the bucket can no longer be asked."""

    state_schema = ""

    def __init__(self, window_us: int, bucket_us: int):
        self.window_us = window_us
        self.bucket_us = bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.state_schema)

    def expires_at(self, key) -> int:
        """Milliseconds after which no event of the bucket can arrive any more."""
        return int((int(key[-1]) + 1) * self.bucket_us + self.window_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Levels(_Bucketed):
    state_schema = "us bigint, seq bigint, value string"

    def __init__(self, window_us: int, bucket_us: int, distinct: bool):
        super().__init__(window_us, bucket_us)
        self.distinct = distinct

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        known = [(us, seq, value) for us, seq, value in self.rows.get()] if self.rows.exists() else []
        members = new[new["member"]]
        added = list(zip(members["us"], members["seq"], members["value"]))
        if added:
            self.rows.appendList([(int(u), int(s), None if v is None else str(v)) for u, s, v in added])
        if not known:
            self.handle.registerTimer(self.expires_at(key))
        facts = sorted(known + added, key=lambda r: (r[0], r[1]))
        at = np.array([r[0] for r in facts], dtype="int64")
        order = [(r[0], r[1]) for r in facts]
        emitted = new[new["emit"]].sort_values(["us", "seq"])
        levels = []
        low = high = 0
        seen: dict = {}
        for us, seq in zip(emitted["us"], emitted["seq"]):
            while high < len(facts) and order[high] <= (us, seq):
                value = facts[high][2]
                seen[value] = seen.get(value, 0) + 1
                high += 1
            while low < high and at[low] < us - self.window_us:
                value = facts[low][2]
                seen[value] -= 1
                if not seen[value]:
                    del seen[value]
                low += 1
            levels.append(len(seen) - (None in seen) if self.distinct else high - low)
        if levels:
            yield pd.DataFrame({"us": emitted["us"].to_numpy(), "seq": emitted["seq"].to_numpy(), "level": levels})


def stream_trailing(
    events: DataFrame,
    keys: Sequence[str],
    window_secs: float,
    *,
    member: Column,
    emit: Column,
    value: Column | None = None,
    watermark: str = "1 hour",
    bucket_secs: float | None = None,
) -> DataFrame:
    """Trailing count (or, with ``value``, distinct count) per arriving event: ``us``, ``seq``, ``level``."""
    window_us = window_micros(window_secs)
    bucket_us = max(window_us, window_micros(bucket_secs or 0), 1)
    text = F.lit("") if value is None else value.cast("string")
    rows = (
        events.withWatermark("ts", watermark)
        .where(member | emit)
        .dropna(subset=list(keys))
        .select(
            *keys, "ts", "us", "seq", text.alias("value"),
            F.coalesce(member, F.lit(False)).alias("member"),
            F.coalesce(emit, F.lit(False)).alias("_emit"),
            slice_of(F.col("us"), bucket_us).alias("_home"),
            F.explode(_copies(F.col("us"), bucket_us, 0, 1)).alias("bucket"),
        )
        .withColumn("emit", F.col("_emit") & (F.col("_home") == F.col("bucket")))
        .where("emit or member")
    )
    return rows.groupBy(*keys, "bucket").transformWithStateInPandas(
        _Levels(window_us, bucket_us, value is not None),
        outputStructType="us bigint, seq bigint, level bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


class _CoOccurrence(_Bucketed):
    """Kinds ``t``, ``p`` and ``n``; a trigger fires once, as soon as a valid pair is there."""

    state_schema = "kind string, us bigint, seq bigint"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        known = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        if not known:
            self.handle.registerTimer(self.expires_at(key))
        facts = known + [(k, int(u), int(s)) for k, u, s in zip(new["kind"], new["us"], new["seq"])]
        p, n = (np.sort(np.array([r[1] for r in facts if r[0] == kind], dtype="int64")) for kind in "pn")
        waiting, fired = [], []
        for row in facts:
            if row[0] == "t":
                (fired if self.valid(row[1], p, n) else waiting).append(row)
        self.rows.put([r for r in facts if r[0] != "t"] + waiting)
        if fired:
            yield pd.DataFrame({"us": [r[1] for r in fired], "seq": [r[2] for r in fired]})

    def valid(self, t: int, p: np.ndarray, n: np.ndarray) -> bool:
        def sides(times):
            i = np.searchsorted(times, t, side="right")
            return [int(x) for x in times[max(i - 1, 0) : i + 1]]

        return any(
            max(t, a, b) - min(t, a, b) <= self.window_us for a in sides(p) for b in sides(n)
        )


def stream_co_occurrence(
    events: DataFrame,
    window_secs: float,
    *,
    trigger: Column,
    first: Column,
    second: Column,
    by: Sequence[str] = (),
    watermark: str = "1 hour",
) -> DataFrame:
    """Triggers with a ``first`` and a ``second`` event within the window: ``us``, ``seq``. An event has all roles it fits."""
    window_us = max(1, window_micros(window_secs))
    us = F.col("us")
    kinds = F.array(F.when(trigger, "t"), F.when(first, "p"), F.when(second, "n"))
    rows = (
        events.withWatermark("ts", watermark)
        .select(*by, "ts", "us", "seq", F.explode(kinds).alias("kind"), slice_of(us, window_us).alias("_home"))
        .where("kind is not null")
        .select("*", F.explode(_copies(us, window_us, 1, 1)).alias("bucket"))
        .where("kind <> 't' or bucket = _home")
    )
    return rows.groupBy(*by, "bucket").transformWithStateInPandas(
        _CoOccurrence(window_us, window_us),
        outputStructType="us bigint, seq bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def running_score(detections: DataFrame) -> DataFrame:
    """Score and detections so far per severity; update mode on a stream of detections."""
    return detections.groupBy("severity").agg(
        F.count("*").alias("detections"), F.sum("score_contribution").alias("score")
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> DataFrame:
    """Process everything available now into a sink folder, then read it back as a batch frame."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = (
        stream.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.format(fmt).schema(stream.schema).load(path)
