"""All rules on a stream, with the same results as over the stored table.

``LiveDetection.process`` is the function of a ``foreachBatch`` sink. Every micro-batch moves a horizon: the greatest
event time so far less the allowed delay. Up to the horizon no on-time event can be missing any more, so the events
between the last horizon and the new one are swept in the order of event time, whatever order they came in.

What has to be known of the past is small and is stored in the shared folder, one folder per batch:

* ``future``: an event that counts raises its level when it is swept and lowers it when it leaves the window. The lowering
  is known at once and waits here; a batch reads what falls due between two horizons, so every event is written and read
  once, not once per batch.
* ``levels``: count and sum of every (rule, key) that is not zero at the horizon, one row each.
* ``seen``: for distinct counts and presence tests the last sighting of every (rule, key, value) still in the window; what
  expires between two horizons leaves it. Sightings of a slice collapse to first and last before they are shuffled.
* ``arrived``: events of the types that windowed rules need, until they are swept (frame rules: until the window behind
  their triggers has passed). They are sorted by time, so a read prunes by its range.

The sweep is the one of ``detect``: levels run inside slices of a key's time, so neither a hot key nor a rule without a key
puts all events into one task. Frame rules (co-occurrence, the caller's own) answer the triggers whose window on both sides
lies before the horizon, a quarter of a window at a time, so an event is read a bounded number of times.

Rows that come after the horizon has passed them are late: stateless rules still see them, windowed rules do not; they
are kept in ``late`` and counted. Everything of a batch is written into folders named by its id, and the record in
``commits`` comes last. A batch that is repeated after a failure overwrites its own folders, one that was committed changes
nothing, so detections, running score and report count each event once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..fixed_values import DEFAULT_WINDOW_SECS, SEVERITIES
from ..operators import report
from ..operators.context import pack, running_levels, slice_micros, slice_of, unpack_seq, unpack_us, window_micros
from ..plans.builtin import builtin_rules
from ..plans.detect import KEYS, AMOUNT, finish, fired_levels, fired_rows, level_deltas, level_sightings, needed_types, only_types, stateless_detections
from ..plans.rules import FrameRule, LevelRule, Rule, StatelessRule
from ..schema import DETECTION_SCHEMA

FUTURE = "_rule int, _k1 string, _k2 string, us bigint, seq bigint, _n bigint, _amount decimal(20,0)"
LEVELS = "_rule int, _k1 string, _k2 string, _n bigint, _amount decimal(38,0)"
SEEN = "_rule int, _k1 string, _k2 string, _value string, _window bigint, last bigint"
PIECES = f"{SEEN}, first_us bigint, first_seq bigint, old boolean, opens boolean, closes boolean, open_end boolean"
COMMIT = (
    "batch bigint, rules string, events bigint, late bigint, max_us bigint, arrived_max bigint, horizon bigint, frames_through bigint, "
    "summary map<string,struct<detections:bigint,score:bigint>>, last boolean"
)
MEASURES = ["_n", "_amount"]
#: A file is one row group of one task at least, however many rows a batch has.
ROWS_A_FILE = 50_000


def _between(us: Column, after: int | None, to: int | None) -> Column:
    """after < us <= to; None is no bound."""
    low = F.lit(True) if after is None else us > F.lit(after)
    return low if to is None else low & (us <= F.lit(to))


class LiveDetection:
    """State and sinks of one stream in ``folder``; give the same folder and rules again to go on after a stop."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        rules: Sequence[Rule] | None = None,
        window_secs: float = DEFAULT_WINDOW_SECS,
        *,
        delay_secs: float = 3600,
        slice_secs: float | None = None,
        host_expr: Column | None = None,
    ):
        self.spark, self.folder, self.host_expr = spark, folder.rstrip("/"), host_expr
        rules = list(builtin_rules() if rules is None else rules)
        self.rule_ids = json.dumps([r.rule_id for r in rules])
        self.stateless, self.levels, self.frames = ([r for r in rules if isinstance(r, kind)] for kind in (StatelessRule, LevelRule, FrameRule))
        self.window_secs, self.delay_us, self.slice_secs = window_secs, window_micros(delay_secs), slice_secs
        self.level_us = max([self._window_us(r) for r in self.levels], default=0)
        self.frame_us = max([self._window_us(r) for r in self.frames], default=0)
        self._live: dict[str, set[int]] = {}
        self.commits = {r["batch"]: r.asDict(recursive=True) for r in self._committed().collect()} if self._exists("commits") else {}
        if any(c["rules"] != self.rule_ids for c in self.commits.values()):
            raise ValueError("the folder holds the state of other rules")

    # Storage ----------------------------------------------------------------------------------------------------

    def _path(self, name: str, batch: int | None = None) -> str:
        return f"{self.folder}/{name}" + ("" if batch is None else f"/batch={batch}")

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def _exists(self, name: str, batch: int | None = None) -> bool:
        system, place = self._hadoop(self._path(name, batch))
        return system.exists(place)

    def _read(self, name: str, batches: Sequence[int], schema: str | StructType) -> DataFrame:
        paths = [self._path(name, b) for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, frame: DataFrame, name: str, batch: int) -> None:
        frame.write.mode("overwrite").option("maxRecordsPerFile", ROWS_A_FILE).parquet(self._path(name, batch))

    def _committed(self) -> DataFrame:
        return self.spark.read.schema(COMMIT).json(self._path("commits"))

    @property
    def last(self) -> dict:
        """The record of the last batch."""
        return self.commits[max(self.commits)] if self.commits else {}

    def _drop_passed(self) -> None:
        """Deletes what no later batch reads: swept events, departures that are past, states before the last two."""
        now = self.last
        if now["horizon"] is None:
            return
        done = now["horizon"] if not self.frames else (now["frames_through"] or -(1 << 62)) - self.frame_us
        gone = [("arrived", b) for b, c in self.commits.items() if c["arrived_max"] is None or c["arrived_max"] <= min(done, now["horizon"])]
        gone += [("future", b) for b, c in self.commits.items() if c["horizon"] is not None and c["horizon"] + self.level_us + 1 <= now["horizon"]]
        gone += [(name, b) for name in ("levels", "seen", "pieces") for b in sorted(self.commits)[:-2]]
        for name, b in gone:
            system, place = self._hadoop(self._path(name, b))
            if system.exists(place):
                system.delete(place, True)
            self.live(name).discard(b)

    def live(self, name: str) -> set[int]:
        """Committed batches whose folder is still there."""
        if name not in self._live:
            self._live[name] = {b for b in self.commits if self._exists(name, b)}
        return self._live[name]

    # A batch ----------------------------------------------------------------------------------------------------

    def _window_us(self, rule: LevelRule | FrameRule) -> int:
        return window_micros(rule.window_secs if rule.window_secs is not None else self.window_secs)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of normalised events; the function for ``foreachBatch``."""
        if batch_id in self.commits or self.last.get("last"):
            return
        if self.host_expr is not None:
            batch = batch.withColumn("host", F.coalesce(F.col("host"), self.host_expr))
        horizon = self.last.get("horizon")
        windowed = [*self.levels, *self.frames]
        batch = batch.persist()
        try:
            on_time = _between(F.col("us"), horizon, None)
            events, late, newest = batch.agg(F.count(F.lit(1)), F.count_if(~on_time), F.max("us")).first()
            if late:
                self._write(batch.where(~on_time), "late", batch_id)
            kept = only_types(batch.where(on_time), needed_types(windowed)).sortWithinPartitions("us")
            arrived_max = None
            if windowed:
                self._write(kept, "arrived", batch_id)
                arrived_max = self.spark.read.schema(batch.schema).parquet(self._path("arrived", batch_id)).agg(F.max("us")).first()[0]
            if self.stateless:
                self._write(finish(stateless_detections(batch, self.stateless)), "plain", batch_id)
        finally:
            batch.unpersist()
        newest = max([x for x in (newest, self.last.get("max_us")) if x is not None], default=None)
        to = None if newest is None else newest - self.delay_us - 1
        self._advance(batch_id, batch.schema, to, {"events": events, "late": late, "max_us": newest, "arrived_max": arrived_max, "last": False})

    def close(self, schema: StructType) -> None:
        """End of input: sweeps what still waits for the delay. Later batches are ignored."""
        if not self.last.get("last"):
            newest = self.last.get("max_us")
            self._advance(max(self.commits, default=-1) + 1, schema, newest, {"events": 0, "late": 0, "max_us": newest, "arrived_max": None, "last": True})

    def _advance(self, batch_id: int, schema: StructType, to: int | None, record: dict) -> None:
        """Sweeps from the last horizon to the new one, writes detections and state, then the record."""
        after, through = self.last.get("horizon"), self.last.get("frames_through")
        there = sorted(self.live("arrived") | ({batch_id} if record["arrived_max"] is not None else set()))
        arrived = self._read("arrived", there, schema)
        parts = []
        if self.levels and to is not None:
            parts.append(finish(self._sweep(batch_id, arrived.where(_between(F.col("us"), after, to)), after, to)))
        if self.frames and to is not None:
            upto = to if record["last"] else to - self.frame_us
            if record["last"] or through is None or upto - through >= self.frame_us // 4:
                seen = arrived.where(_between(F.col("us"), None if through is None else through - self.frame_us - 1, upto + self.frame_us))
                for rule in self.frames:
                    length = rule.window_secs if rule.window_secs is not None else self.window_secs
                    found = rule.find(seen, length).where(_between(F.col("us"), through, upto))
                    parts.append(finish(fired_rows([rule], found, F.lit(0))))
                through = upto
        found = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], DETECTION_SCHEMA)
        self._write(found, "windowed", batch_id)
        sums = self._detections([batch_id], [] if record["last"] else [batch_id])
        sums = sums.groupBy("severity").agg(F.count(F.lit(1)).alias("detections"), F.sum("score_contribution").alias("score")).collect()  # five rows at most
        record |= {
            "batch": batch_id, "rules": self.rule_ids, "horizon": to if to is not None else after, "frames_through": through,
            "summary": {r["severity"]: {"detections": r["detections"], "score": r["score"]} for r in sums},
        }
        self.spark.createDataFrame([record], COMMIT).coalesce(1).write.mode("overwrite").json(self._path("commits", batch_id))
        self.commits[batch_id] = record
        written = {"arrived": record["arrived_max"] is not None, "future": bool(self.levels) and to is not None}
        written |= {name: bool(self.levels) and to is not None and self._exists(name, batch_id) for name in ("levels", "seen", "pieces")}
        for name, there in written.items():
            if there:
                self.live(name).add(batch_id)
        self._drop_passed()

    # Levels -----------------------------------------------------------------------------------------------------

    def _sweep(self, batch_id: int, ready: DataFrame, after: int | None, to: int) -> DataFrame:
        """Firings of the level rules for the events between the horizons; writes the state at the new horizon."""
        slice_us = slice_micros(self.level_us, self.slice_secs)
        us = F.col("us")
        new = level_deltas(ready, self.levels, self._window_us)
        later = new.where(us > to).select(*KEYS, "us", "seq", F.col("_n").cast("bigint").alias("_n"), F.col("_amount").cast(AMOUNT).alias("_amount"))
        self._write(later.sortWithinPartitions("us"), "future", batch_id)
        due = self._read("future", sorted(self.live("future")), FUTURE).where(_between(us, after, to))

        past = max((b for b in self.live("levels")), default=None)
        base = self._read("levels", [] if past is None else [past], LEVELS).select(*KEYS, F.lit(after).cast("bigint").alias("us"), F.lit(0).cast("bigint").alias("seq"), *MEASURES)
        quiet = due.unionByName(base).withColumn("_late", F.lit(0))
        if any(r.measure in ("distinct", "present") for r in self.levels):
            quiet = quiet.unionByName(self._presence(batch_id, ready, past, to, slice_us))
        quiet = quiet.withColumns({"_probe": F.lit(0), "_emit": F.lit(False)})
        deltas = new.where(us <= to).unionByName(quiet, allowMissingColumns=True)
        sums = deltas.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        nonzero = (F.coalesce(F.col("_n"), F.lit(0)) != 0) | (F.coalesce(F.col("_amount"), F.lit(0)) != 0)
        self._write(sums.where(nonzero).select(*KEYS, F.col("_n").cast("bigint").alias("_n"), F.col("_amount").cast("decimal(38,0)").alias("_amount")), "levels", batch_id)
        return fired_levels(running_levels(deltas, KEYS, MEASURES, slice_us), self.levels)

    def _presence(self, batch_id: int, ready: DataFrame, past: int | None, to: int, slice_us: int) -> DataFrame:
        """Edges of presence up to the horizon: +1 when a value enters the window of its key, -1 after its last sighting has
        left it. What has not left yet stays in ``seen`` with its last sighting."""
        pair = [*KEYS, "_value", "_window"]
        at = pack(F.col("us"), F.col("seq"))
        pieces = []
        for window_us, members in level_sightings(ready, self.levels, self._window_us).items():
            length = max(1, min(slice_us, window_us))
            pieces.append(
                members.where("_value is not null")
                .withColumn("_window", F.lit(window_us).cast("bigint"))
                .groupBy(*pair, slice_of(F.col("us"), length).alias("_piece"))
                .agg(F.min(at).alias("_first"), F.max("us").alias("last"))
                .select(*pair, "last", unpack_us(F.col("_first")).cast("bigint").alias("first_us"), unpack_seq(F.col("_first")).alias("first_seq"), F.lit(False).alias("old"))
            )
        known = self._read("seen", [] if past is None else [past], SEEN)  # written whenever levels is
        pieces.append(known.select(*pair, "last", F.col("last").alias("first_us"), F.lit(0).cast("bigint").alias("first_seq"), F.lit(True).alias("old")))
        along = Window.partitionBy(*pair).orderBy("first_us", "last")
        next_first = F.lead("first_us").over(along)
        gone = F.col("last") + F.col("_window") + 1
        marked = reduce(DataFrame.unionByName, pieces).select(
            *pair, "last", "first_us", "first_seq", "old",
            (~F.col("old") & F.coalesce(F.col("first_us") - F.lag("last").over(along) > F.col("_window"), F.lit(True))).alias("opens"),
            F.when(next_first.isNull(), gone <= to).otherwise(next_first - F.col("last") > F.col("_window")).alias("closes"),
            (next_first.isNull() & (gone > to)).alias("open_end"),
        )
        self._write(marked, "pieces", batch_id)
        stored = self._read("pieces", [batch_id], PIECES)
        self._write(stored.where("open_end").select(*pair, "last"), "seen", batch_id)

        def edge(us: Column, late: int, delta: int) -> Column:
            amount = F.lit(None).cast(AMOUNT)
            return F.struct(us.alias("us"), F.col("first_seq").alias("seq"), F.lit(late).alias("_late"), F.lit(delta).cast("bigint").alias("_n"), amount.alias("_amount"))

        edges = F.array_compact(F.array(F.when(F.col("opens"), edge(F.col("first_us"), 1, 1)), F.when(F.col("closes"), edge(F.col("last") + F.col("_window") + 1, 0, -1))))
        return stored.select(*KEYS, F.inline_outer(edges)).where("us is not null")

    # Results ----------------------------------------------------------------------------------------------------

    def _detections(self, windowed: Sequence[int], plain: Sequence[int]) -> DataFrame:
        found = self._read("windowed", windowed, DETECTION_SCHEMA)
        return found.unionByName(self._read("plain", plain, DETECTION_SCHEMA)) if self.stateless and plain else found

    def detections(self) -> DataFrame:
        """Detections of all committed batches."""
        return self._detections(sorted(self.commits), [b for b, c in sorted(self.commits.items()) if not c["last"]])

    def late_rows(self, schema: StructType) -> DataFrame:
        """Rows that came after the horizon had passed them, with all their columns."""
        return self._read("late", [b for b, c in sorted(self.commits.items()) if c["late"]], schema)

    def running_score(self) -> DataFrame:
        """Detections and score so far per severity, from the records of the batches."""
        if not self.commits:
            return self.spark.createDataFrame([], "severity string, detections bigint, score bigint")
        each = self._committed().select(F.explode("summary").alias("severity", "s"))
        return each.groupBy("severity").agg(F.sum("s.detections").alias("detections"), F.sum("s.score").alias("score"))

    def report(self, generated_at: Column | None = None) -> DataFrame:
        """The report record so far, from the records of the batches alone: events processed, score, level, summary."""
        if not self.commits:
            raise ValueError("no batch was processed")
        commits = self._committed()
        score = [F.coalesce(F.sum(F.aggregate(F.map_values("summary"), F.lit(0).cast("bigint"), lambda a, s: a + s["score"])), F.lit(0)).alias("_score")]
        count = lambda name: F.coalesce(F.col("summary")[name]["detections"], F.lit(0))
        per = [F.sum(count(s)).alias(s.lower()) for s in reversed(SEVERITIES)]
        counts = commits.agg(F.sum("events").alias("events_processed"), *score, *per)
        names = [s.lower() for s in reversed(SEVERITIES)]
        total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
        return report.assembled(counts.withColumn("total", total), F.lit(0.0), generated_at)


def run_live(stream: DataFrame, live: LiveDetection, checkpoint: str, end: bool = True) -> LiveDetection:
    """Processes everything that is available now; ``end`` closes the input."""
    query = stream.writeStream.foreachBatch(live.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if end:
        live.close(stream.schema)
    return live
