"""Stream results equal batch results, in several micro-batches."""

from pyspark.sql import functions as F

from eventloom.driver_view import WINDOW_SECS, project_events
from eventloom.operators import context
from eventloom.operators.cooccurrence import co_occurrence
from eventloom.plans.builtin import builtin_rules
from eventloom.plans.detect import detect
from eventloom.plans.rules import StatelessRule
from eventloom.streaming.detect import run_to_end, running_score, stream_co_occurrence, stream_stateless, stream_trailing

SAMPLE = "/root/testdata/sf0.001/events.parquet"


def is_(name):
    return F.col("event_type") == name


def batch_and_stream(spark, tmp_path, files=3):
    table = spark.read.parquet(SAMPLE)
    folder = str(tmp_path / "in")
    # files in event-time order, written one after the other and read one per micro-batch
    step = table.count() // files + 1
    for i in range(files):
        part = table.where(F.col("event_id").between(i * step, (i + 1) * step - 1))
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return project_events(table), project_events(stream)


def test_stateless(spark, tmp_path):
    batch, stream = batch_and_stream(spark, tmp_path)
    rules = [r for r in builtin_rules() if isinstance(r, StatelessRule)]
    out = run_to_end(stream_stateless(stream, rules), str(tmp_path / "out"), str(tmp_path / "ck"))
    want = {r.detection_id for r in detect(batch, rules).collect()}
    assert {r.detection_id for r in out.collect()} == want and want


def test_levels(spark, tmp_path):
    batch, stream = batch_and_stream(spark, tmp_path)
    net = is_("network_connection")
    counted = run_to_end(
        stream_trailing(stream, ["host"], WINDOW_SECS, member=net, emit=net, watermark="30 days"),
        str(tmp_path / "o1"), str(tmp_path / "c1"),
    )
    want = {r.seq: r.n for r in context.trailing_count(batch, ["host"], WINDOW_SECS, member=net, emit=net).collect()}
    assert {r.seq: r.level for r in counted.collect()} == want
    distinct = run_to_end(
        stream_trailing(stream, ["host"], WINDOW_SECS, member=net, emit=net, value=F.col("dst_port"), watermark="30 days"),
        str(tmp_path / "o2"), str(tmp_path / "c2"),
    )
    both = context.trailing_distinct(batch, ["host"], WINDOW_SECS, F.col("dst_port"), member=net, emit=net)
    assert {r.seq: r.level for r in distinct.collect()} == {r.seq: r.n for r in both.collect()}


def test_co_occurrence_and_running_score(spark, tmp_path):
    batch, stream = batch_and_stream(spark, tmp_path)
    shell = is_("process_creation") & F.lower("cmd").contains("powershell")
    args = dict(trigger=is_("service_installation"), first=shell, second=is_("network_connection"))
    found = run_to_end(
        stream_co_occurrence(stream, 86_400, watermark="30 days", **args), str(tmp_path / "out"), str(tmp_path / "ck")
    )
    want = {r.seq for r in co_occurrence(batch, 86_400, **args).collect()}
    rows = [r.seq for r in found.collect()]
    assert sorted(rows) == sorted(want) and want

    rules = [r for r in builtin_rules() if r.rule_id == "FILE-DROP-001"]
    query = (
        running_score(stream_stateless(stream, rules)).writeStream.outputMode("update").format("memory")
        .queryName("scores").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = spark.table("scores").agg(F.max("detections"), F.max("score")).first()
    n = detect(batch, rules).count()
    assert tuple(last) == (n, 30 * n)


def test_an_event_has_all_its_roles(spark, tmp_path):
    batch, stream = batch_and_stream(spark, tmp_path)
    net = is_("network_connection")
    args = dict(trigger=net, first=net, second=net | is_("process_creation"))
    found = run_to_end(
        stream_co_occurrence(stream, 3600, watermark="30 days", **args), str(tmp_path / "out"), str(tmp_path / "ck")
    )
    want = sorted(r.seq for r in co_occurrence(batch, 3600, **args).collect())
    assert sorted(r.seq for r in found.collect()) == want and want
