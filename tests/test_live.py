"""All rules on a stream give what they give over the stored table, batch by batch, in any order within the delay."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.driver_view import WINDOW_SECS, project_events
from eventloom.operators import report
from eventloom.plans.builtin import builtin_rules
from eventloom.plans.detect import detect
from eventloom.plans.rules import LevelRule
from eventloom.streaming.live import LiveDetection, run_live

SAMPLE = "/root/testdata/sf0.001/events.parquet"
SECOND = 1_000_000


def found(detections):
    rows = detections.select("rule_id", "trigger_seq", "severity", F.array_join("event_ids", ","), F.array_join("evidence", ";")).collect()
    return Counter(map(tuple, rows))


def test_all_rules_in_any_order_with_restarts_and_repeated_batches(spark, tmp_path):
    events = project_events(spark.read.parquet(SAMPLE)).cache()
    delay = 2 * 86_400
    # Events come up to the delay after their time.
    rng = random.Random(3)
    came = sorted((r.us + rng.randrange(delay * SECOND), r.seq) for r in events.select("us", "seq").collect())
    turn = {seq: i * 4 // len(came) for i, (_, seq) in enumerate(came)}
    placed = events.join(spark.createDataFrame(list(turn.items()), "seq long, turn int"), "seq").cache()
    folder = str(tmp_path / "state")

    def batch(i):
        return placed.where(F.col("turn") == i).drop("turn")

    for i in range(4):
        live = LiveDetection(spark, folder, window_secs=WINDOW_SECS, delay_secs=delay)  # a restart before every batch
        if i == 2:  # what a failed attempt has left
            for name in ("windowed", "plain", "levels", "seen", "future"):
                live._write(events.limit(5), name, i)
        live.process(batch(i), i)
        if i == 1:
            before = found(live.detections())
            live.process(batch(i), i)
            LiveDetection(spark, folder, window_secs=WINDOW_SECS, delay_secs=delay).process(batch(3), i)
            assert found(live.detections()) == before
    live.close(events.schema)
    live.close(events.schema)
    live.process(batch(0), 9)  # after the end nothing is taken
    whole = detect(events, window_secs=WINDOW_SECS).cache()
    assert found(live.detections()) == found(whole)
    assert live.late_rows(events.schema).count() == 0
    score = {r.severity: (r.detections, r.score) for r in live.running_score().collect()}
    assert score == {r.severity: (r.n, r.s) for r in whole.groupBy("severity").agg(F.count("*").alias("n"), F.sum("score_contribution").alias("s")).collect()}
    same = lambda header: header.select("events_processed", "score", "summary").first()
    assert same(live.report()) == same(report.report_header(events, whole))
    with pytest.raises(ValueError):
        LiveDetection(spark, folder, builtin_rules()[:3], WINDOW_SECS)


def events_of(spark, rows):
    """(seconds, host, type, user) as canonical events, numbered in order."""
    names = project_events(spark.read.parquet(SAMPLE)).schema
    frame = spark.createDataFrame([(i, int(t * SECOND), h, k, u) for i, (t, h, k, u) in enumerate(rows)], "seq long, us long, host string, event_type string, user string")
    given = {"event_id": F.concat(F.lit("e"), F.col("seq")), "source_ip": F.lit("10.0.0.9")}
    return frame.select(*[
        (F.col(f.name) if f.name in frame.columns else given.get(f.name, F.timestamp_micros("us") if f.name == "ts" else F.lit(None))).cast(f.dataType).alias(f.name)
        for f in names
    ])


def small(ids):
    return [r for r in builtin_rules() if r.rule_id in ids]


def test_late_rows_are_kept_and_do_not_count(spark, tmp_path):
    failed = "login_failure"
    first = [(100 + i, "A", failed, "u") for i in range(4)] + [(200, "A", "other", "u")]
    late = [(139.999999, "A", failed, "u"), (140, "A", failed, "v")]  # the delay is a minute: the first one is late by a microsecond
    events = events_of(spark, first + late).cache()
    live = LiveDetection(spark, str(tmp_path / "s"), small(["AUTH-BRUTE-001"]), 120, delay_secs=60)
    live.process(events.where("seq < 5"), 0)
    live.process(events.where("seq = 99"), 1)  # an empty batch changes nothing
    live.process(events.where("seq >= 5"), 2)
    live.close(events.schema)
    assert [r.seq for r in live.late_rows(events.schema).collect()] == [5]
    assert [c["late"] for c in live.commits.values()] == [0, 0, 1, 0]
    assert [(r.trigger_seq, r.evidence) for r in live.detections().collect()] == [(6, ["5 failed login attempts against host 'A' from 10.0.0.9"])]


def test_state_follows_the_window_and_not_the_past(spark, tmp_path):
    """Twelve windows of a hot key: what is stored for the next batch stays as large as one window."""
    rng = random.Random(5)
    kinds = ["login_failure", "network_connection", "process_creation", "registry_modification"]
    rows = [(i * 0.5, "A" if rng.random() < 0.5 else f"H{i % 5}", rng.choice(kinds), f"u{rng.randrange(40)}") for i in range(480)]
    events = events_of(spark, rows).cache()
    rules = [r for r in small(["AUTH-BRUTE-001", "AUTH-SPRAY-001"]) if isinstance(r, LevelRule)]
    live = LiveDetection(spark, str(tmp_path / "s"), rules, 20, delay_secs=5, slice_secs=2)
    sizes = []
    for i in range(6):
        live.process(events.where(F.col("seq").between(i * 80, i * 80 + 79)), i)
        rows_in = lambda name: sum(spark.read.parquet(live._path(name, b)).count() for b in live.live(name))
        sizes.append([rows_in("future"), rows_in("arrived"), spark.read.parquet(live._path("seen", i)).count(), spark.read.parquet(live._path("levels", i)).count()])
    live.close(events.schema)
    assert found(live.detections()) == found(detect(events, rules, 20)) and found(live.detections())
    assert all(b <= 2 * max(a, 20) for a, b in zip(sizes[1], sizes[-1])), sizes
    assert len(live.live("arrived")) <= 3 and len(live.live("future")) <= 3


def test_a_stream_query_drives_it(spark, tmp_path):
    table = spark.read.parquet(SAMPLE)
    for i in range(3):
        table.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = project_events(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    live = LiveDetection(spark, str(tmp_path / "s"), small(["PS-LATERAL-001"]), 86_400, delay_secs=60 * 86_400)
    run_live(stream, live, str(tmp_path / "c"))
    assert len(live.commits) == 4  # three batches and the end
    want = found(detect(project_events(table), small(["PS-LATERAL-001"]), 86_400))
    assert found(live.detections()) == want and want


def test_a_batch_of_one_partition_is_kept_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("eventloom.streaming.live.ROWS_A_FILE", 20, raising=False)
    events = project_events(spark.read.parquet(SAMPLE)).coalesce(1)
    live = LiveDetection(spark, str(tmp_path / "state"), [r for r in builtin_rules() if r.rule_id == "PS-LATERAL-001"], WINDOW_SECS, delay_secs=86_400)
    live.process(events, 0)
    kept = spark.read.parquet(str(tmp_path / "state" / "arrived" / "batch=0"))
    sizes = [r["count"] for r in kept.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 20
