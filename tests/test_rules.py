"""End-to-end: raw JSON lines through normalisation, all rules and the report."""

import json
import random

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from eventloom.fixed_values import RULE_HEADS, THREAT_BANDS
from eventloom.operators import report
from eventloom.operators.normalize import normalize
from eventloom.plans import sigma
from eventloom.plans.builtin import builtin_rules
from eventloom.plans.custom import batch_rule, context_rule
from eventloom.plans.detect import detect, rule_set
from eventloom.plans.rule_index import RuleIndex
from eventloom.plans.rules import Branch, FrameRule, LevelRule, RuleSet, StatelessRule
from eventloom.schema import DETECTION_SCHEMA, threat_level
from eventloom.sources.lines import json_records


def normal(spark, records, **options):
    rows = [r if isinstance(r, tuple) else (i, json.dumps(r)) for i, r in enumerate(records)]
    lines = spark.createDataFrame(rows, "seq bigint, value string").withColumn("file", F.lit("mem"))
    received = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("seq") * 1_000_000)
    # one evaluation for all passes, as a stored event table would give
    return normalize(json_records(lines, received), **options).cache()


def run(spark, records, **options):
    return detect(normal(spark, records), **options).collect()


def run_all(spark, scenarios, **options):
    """Several scenarios in one run, hours apart so that no window spans two of them."""
    records = [(n * 10_000 + i, json.dumps(r)) for n, records in enumerate(scenarios) for i, r in enumerate(records)]
    out = [[] for _ in scenarios]
    for row in detect(normal(spark, records), **options).collect():
        out[row.trigger_seq // 10_000].append(row)
    return out


def ids(rows):
    return sorted(r.rule_id for r in rows)


SHELL = {"event_type": "process_creation", "cmd": "powershell.exe -EncodedCommand AGUA", "host": "WS1", "user": "jd", "pid": "4521"}
NET = {"event_type": "network_connection", "host": "WS1", "dst_ip": "192.168.100.50", "dst_port": "443", "bytes_out": "15234"}
SERVICE = {"event_type": "service_installation", "host": "WS1", "service_name": "updater"}


def failure(host="SRV", user="admin"):
    return {"event_type": "login_failure", "host": host, "user": user, "source_ip": "10.0.0.99"}


def test_every_rule_is_registered(spark):
    rules = builtin_rules()
    assert {r.rule_id for r in rules} == set(RULE_HEADS) and len(RULE_HEADS) == 28


def test_combined_report(spark):
    events = normal(spark, [SHELL, NET, SERVICE] + [failure() for _ in range(5)])
    found = detect(events).cache()
    assert [f.name for f in found.schema] == DETECTION_SCHEMA.names
    assert [f.dataType for f in found.schema] == [f.dataType for f in DETECTION_SCHEMA]
    rows = {r.rule_id: r for r in found.collect()}
    assert sorted(rows) == ["AUTH-BRUTE-001", "EXEC-ENCODE-001", "PS-LATERAL-001"]
    lateral = rows["PS-LATERAL-001"]
    assert len(lateral.event_ids) == 3 and lateral.score_contribution == 50
    assert lateral.evidence == [
        "PowerShell spawned: powershell.exe -EncodedCommand AGUA",
        "Outbound connection to 192.168.100.50:443",
        "Service installed: updater",
    ]
    assert rows["AUTH-BRUTE-001"].evidence == ["5 failed login attempts against host 'SRV' from 10.0.0.99"]
    assert rows["AUTH-BRUTE-001"].trigger_seq == 7
    assert rows["EXEC-ENCODE-001"].evidence[0] == "Obfuscation patterns matched: -encodedcommand"
    header = report.report_header(events, found, 0.5).first()
    assert header.events_processed == 8 and header.score.score == 110
    assert header.score.threat_level == "CRITICAL_INCIDENT"
    assert header.summary.asDict() == {"total": 3, "critical": 1, "high": 2, "medium": 0, "low": 0, "info": 0}
    text = json.loads(report.report_json(report.report_header(events, found)).first().report)
    assert text["summary"]["total"] == 3 and text["score"]["score"] == 110
    by_rule = {(r.rule_id, r.severity): r.detections for r in report.detections_by_rule(found).collect()}
    assert by_rule[("PS-LATERAL-001", "Critical")] == 1
    assert [r.rule_id for r in report.ordered(found).collect()][-1] == "AUTH-BRUTE-001"


def test_order_and_nesting_do_not_matter_for_lateral(spark):
    nested = {k: v for k, v in SHELL.items() if k not in ("cmd", "pid")}
    nested["metadata"] = {"cmd": SHELL["cmd"], "pid": 4521}
    def apart(day, net):
        at = f"2024-01-{day}T10:"
        return [{**SHELL, "timestamp": at + "00:00Z"}, {**NET, "timestamp": at + net}, {**SERVICE, "timestamp": at + "01:00Z"}]

    got = run_all(spark, [[SHELL, SERVICE, NET], [nested, NET, SERVICE], apart(15, "02:00Z"), apart(16, "02:00.000001Z")])
    assert ["PS-LATERAL-001" in ids(rows) for rows in got] == [True, True, True, False]


def test_filter_disable_and_empty(spark):
    records = [SHELL, NET, SERVICE]
    events = normal(spark, records, hosts=["other"])
    assert events.count() == 0
    found = detect(events)
    assert report.severity_summary(found).first().total == 0
    assert tuple(report.score_level(found).first()) == (0, "CLEAN")
    assert "PS-LATERAL-001" not in ids(run(spark, records, disabled=["PS-LATERAL-001"]))


def test_brute_force_levels(spark):
    nameless = {k: v for k, v in failure().items() if k != "host"}
    four, five, ten, unnamed = run_all(
        spark, [[failure()] * 4, [failure()] * 5 + [failure("OTHER")], [failure()] * 10, [nameless] * 5]
    )
    assert (ids(four), ids(five), ids(unnamed)) == ([], ["AUTH-BRUTE-001"], [])
    assert [r.trigger_seq % 100 for r in sorted(ten, key=lambda r: r.trigger_seq)] == [4, 9]
    found = detect(normal(spark, [nameless] * 5), host_expr=F.col("source_ip")).collect()
    assert ids(found) == ["AUTH-BRUTE-001"]


def test_windowed_rules(spark):
    spray = [failure(f"H{i}", f"u{i}") for i in range(5)]
    success = {**failure(), "event_type": "login_success"}
    dns = {"event_type": "dns_query", "host": "D", "query": "a.b"}
    long_name = {"event_type": "dns_query", "query": "é" * 21, "dst_ip": "9.9.9.9"}
    key = {"event_type": "registry_modification", "key": r"HKLM\Software\Microsoft\Windows\CurrentVersion\Run", "host": "K"}
    cases = {
        "spray": (spray, ["AUTH-SPRAY-001"]),
        # the level stays on a multiple, so every further failure fires again
        "spray again": (spray + [failure("H0", "u0")], ["AUTH-SPRAY-001"] * 2),
        "success": ([failure()] * 3 + [success], ["AUTH-SFBRUTE-001"]),
        "success early": ([failure()] * 2 + [success], []),
        "smb": ([{**NET, "dst_port": "445", "dst_ip": f"10.0.0.{i}"} for i in range(3)], ["NET-SMBLAT-001"]),
        "scan": ([{**NET, "dst_port": str(i), "dst_ip": f"10.0.0.{i}"} for i in range(100, 115)], ["NET-PORTSCAN-001"]),
        "beacon": ([NET] * 8, ["NET-BEACON-001"]),
        "sum": ([{**NET, "dst_ip": f"10.0.{i}.1", "bytes_out": "49999999"} for i in range(11)], ["NET-DATAXFR-001"]),
        "bytes": (
            [{**NET, "bytes_out": b} for b in ("18446744073709551615", "-1", "x", "+60000000", "0", "18446744073709551616")],
            ["NET-DATAXFR-001"] * 2,
        ),
        "dns": ([dns] * 10, ["DNS-TUNNEL-001"]),
        "dns long": ([long_name], ["DNS-TUNNEL-001"]),
        "dns forty": ([{**dns, "query": "q" * 40}], []),
        "ransom": ([{"event_type": "file_creation", "host": "F", "path": f"/d/{i}.LOCKED"} for i in range(10)], ["FILE-RANSOM-001"]),
        "recon": ([{"event_type": "command_execution", "host": "R", "command_line": "WhoAmI"}] * 5, ["EXEC-RECON-001"]),
        "registry": ([key], ["REG-PERSIST-001"]),
        "registry after": ([{"event_type": "process_creation", "cmd": "x", "host": "other"}, key], ["REG-PERSIST-001"]),
    }
    got = dict(zip(cases, run_all(spark, [records for records, _ in cases.values()])))
    assert {name: ids(rows) for name, rows in got.items()} == {name: want for name, (_, want) in cases.items()}
    assert got["success"][0].evidence[0] == "Login SUCCESS for 'admin' on 'SRV' after 3 failures from 10.0.0.99"
    assert got["sum"][0].evidence == ["Cumulative outbound transfer from 'WS1': 0 GB 549 MB in the window"]
    assert sorted(r.evidence[0] for r in got["bytes"]) == [
        "Single outbound transfer of 18446744073709 MB from 'WS1' to 192.168.100.50",
        "Single outbound transfer of 60 MB from 'WS1' to 192.168.100.50",
    ]
    assert got["dns long"][0].evidence == [f"Long DNS query name (42 chars): {'é' * 21}", "Resolver: 9.9.9.9"]
    assert [len(got[n][0].evidence) for n in ("registry", "registry after")] == [3, 4]


COMMANDS = [
    ("procdump -ma LSASS.exe", ["CRED-DUMP-001"]),
    ("sekurlsa::logonpasswords", ["CRED-DUMP-001"]),
    ("rundll32.exe /i http", ["EXEC-LOLBIN-001"]),
    ("rundll32.exe", []),
    ("i`ex ::getstring(", ["EXEC-ENCODE-001"]),
    ("invoke-wmimethod x", ["SUSP-WMI-001"]),
    ("format.exe /change", ["SUSP-SCHTASK-001"]),
    ("dsadd user bob", ["ACCOUNT-CREATE-001"]),
    ("net user bob /ADD", ["ACCOUNT-CREATE-001"]),
    ("bcdedit recoveryenabled", ["EXEC-SHADOW-001"]),
    ("sc config sysmon", ["EXEC-AVDEF-001"]),
    ("add-mppreference -exclusionpath c:", ["EXEC-AVDEF-001"]),
    ("wevtutil cl x", ["EXEC-LOGCLR-001"]),
    ("certutil -decode", ["EXEC-DLCRD-001"]),
    ("downloadfile ; iex", ["EXEC-DLCRD-001"]),
    ("echo pipe\\min_x", ["EXEC-PIPE-001"]),
    ("PAEXEC x", ["EXEC-PSEXEC-001"]),
    ("gzip \\\\srv\\c", ["FILE-ARCEXF-001"]),
]


def test_command_rules(spark):
    records = [{"event_type": "process_creation", "cmd": c} for c, _ in COMMANDS]
    got = {}
    for r in run(spark, records):
        got.setdefault(r.trigger_seq, []).append(r.rule_id)
    assert {i: sorted(v) for i, v in got.items()} == {i: w for i, (_, w) in enumerate(COMMANDS) if w}


def test_other_stateless_rules(spark):
    records = [
        {"event_type": "process_creation", "parent_image": "C:\\WINWORD.EXE", "exe": "C:\\cmd.exe"},
        {"event_type": "command_execution", "parent_image": "C:\\WINWORD.EXE", "exe": "C:\\cmd.exe"},
        {"event_type": "service_installation", "name": "PSEXESVC"},
        {"event_type": "file_creation", "target": "/tmp/a.JS"},
        {"event_type": "file_creation", "file_path": "/home/a.js"},
        {"event_type": "network_connection", "dst_port": "31337"},
        {"event_type": "network_connection", "dst_port": 8080, "dst_ip": "172.32.0.1"},
        {"event_type": "network_connection", "dst_port": "8080", "dst_ip": "172.31.0.1"},
        {"event_type": "network_connection", "dst_port": "8080", "dst_ip": "fe80::1"},
        {"event_type": "network_connection", "dst_port": "8080"},
    ]
    got = {r.trigger_seq: (r.rule_id, r.severity) for r in run(spark, records)}
    assert got == {
        0: ("EXEC-OFFMAC-001", "Critical"), 2: ("EXEC-PSEXEC-001", "High"), 3: ("FILE-DROP-001", "High"),
        5: ("NET-C2PORT-001", "High"), 6: ("NET-C2PORT-001", "Medium"), 8: ("NET-C2PORT-001", "Medium"),
    }


def test_bands(spark):
    edges = [0, 29, 30, 59, 60, 84, 85, 10_000]
    df = spark.createDataFrame([(e,) for e in edges], "score bigint")
    got = [r.t for r in df.orderBy("score").select(threat_level(F.col("score")).alias("t")).collect()]
    want = [next(n for floor, n in THREAT_BANDS if e >= floor) for e in edges]
    assert got == want == ["CLEAN"] * 2 + ["SUSPICIOUS"] * 2 + ["LIKELY_COMPROMISE"] * 2 + ["CRITICAL_INCIDENT"] * 2


# --- Sigma -----------------------------------------------------------------------------

HEAD = "title: {t}\nlogsource: {{category: {c}}}\nlevel: {l}\ntags: [a.b]\n"


def rule_text(title, detection, category="process_creation", level="high"):
    return HEAD.format(t=title, c=category, l=level) + detection


def test_sigma(spark):
    records = [
        {"event_type": "process_creation", "cmd": "Evil.exe run", "user": "bob", "CommandLine": "zz"},
        {"event_type": "process_creation", "cmd": "good", "user": "amy", "n": 5},
        {"event_type": "odd \"x\"", "cmd": "evil"},
    ]
    texts = [
        rule_text("contains", "detection: {s: {cmd|contains: EVIL}, condition: s}"),
        rule_text("exact list", "detection: {s: {user: [AMY, zoe]}, condition: s}"),
        rule_text("ends", "detection: {s: {cmd|endswith: run, user|startswith: b}, condition: s}"),
        rule_text("not or", "detection: {a: {user: bob}, b: {user: amy}, condition: not a or b and a}"),
        rule_text("one of", "detection: {s1: {user: bob}, s2: {user: amy}, condition: 1 of s*}"),
        rule_text("all of", "detection: {s1: {user: bob}, s2: {cmd|contains: evil}, condition: all of s*}"),
        rule_text("none", "detection: {s1: {user: bob}, condition: all of x*}"),
        rule_text("any type", "detection: {s: {cmd|contains: evil}, condition: s}", category="webserver", level="odd"),
        rule_text("number", "detection: {s: {n: 5}, condition: s, timeframe: 5m}"),
        rule_text("nothing", "detection: {s: {n: null}, condition: s}"),
        rule_text("missing", "detection: {s: {nothing: ''}, condition: s}"),
        rule_text("CommandLine", "detection: {s: {CommandLine: zz}, condition: s}"),
        rule_text("unknown set", "detection: {s: {user: bob}, condition: t}"),
        rule_text("all modifier", "detection: {s: {cmd|contains|all: [evil, run]}, condition: s}"),
    ]
    rules = sigma.load_rules(texts=texts)
    assert not rules.errors
    got = {}
    rows = detect(normal(spark, records), rules).collect()
    for r in rows:
        got.setdefault(r.rule_name, set()).add(r.trigger_seq)
    assert got == {
        "contains": {0}, "exact list": {1}, "ends": {0}, "not or": {1}, "one of": {0, 1}, "all of": {0},
        "any type": {0, 2}, "number": {1}, "missing": {0, 1},
    }
    by = {(r.rule_name, r.trigger_seq): r for r in rows}
    assert by[("contains", 0)].rule_id == "SIGMA-contains" and by[("contains", 0)].tags == ["a.b"]
    assert by[("contains", 0)].evidence == ["Sigma rule 'contains' matched on ProcessCreation"]
    odd = by[("any type", 2)]
    assert odd.evidence == ["Sigma rule 'any type' matched on Unknown(\"odd \\\"x\\\"\")"]
    assert (odd.severity, odd.score_contribution) == ("Info", 1)
    loose = sigma.load_rules(texts=[texts[11]], case_insensitive_fields=True)
    assert [r.trigger_seq for r in detect(normal(spark, records), loose).collect()] == [0]


def test_sigma_errors_and_compat(spark, tmp_path):
    bad = [
        "title: x\nlogsource: {}\ndetection: {s: {a: b}}",
        "title: x\nlogsource: {}\ndetection: {s: [a], condition: s}",
        "title: x\ndetection: {s: {a: b}, condition: s}",
        "title: 5\nlogsource: {}\ndetection: {s: {a: b}, condition: s}",
        "title: x\nlogsource: {}\ndetection: {s: {a: b}, condition: s and}",
        "title: x\nlogsource: {}\ndetection: {s: {a: b}, condition: 1 of}",
        "{not yaml",
    ]
    assert len(sigma.load_rules(texts=bad).errors) == len(bad)
    lenient = [f"title: t\nlogsource: {{}}\ndetection: {{s1: {{cmd: a}}, condition: {c}}}" for c in
               ("(s1)", "s1 junk", "not 1 of s*", "1 of them")]
    assert len(sigma.load_rules(texts=lenient).errors) == 4
    compat = sigma.load_rules(texts=lenient, compat=True)
    assert not compat.errors
    events = normal(spark, [{"cmd": "a"}])
    hits = [len(detect(events, [r]).collect()) for r in compat]
    assert hits == [0, 1, 1, 0]
    path = tmp_path / "r.yml"
    path.write_text(lenient[1])
    assert len(sigma.load_rules(paths=[str(path), str(tmp_path / "none.yml")], compat=True)) == 1
    with pytest.raises(Exception):
        sigma.load_rules(texts=bad, strict=True)


def test_rules_as_data_agree_with_columns(spark):
    rules = [
        {"id": "A", "title": "A", "level": "high", "logsource": {"category": "process_creation"},
         "detection": {"s": {"cmd|contains": ["evil", "bad"], "user": "bob"}, "condition": "s"}},
        {"id": "B", "title": "B", "level": "low", "logsource": {},
         "detection": {"s": {"host|endswith": "1"}, "t": {"cmd|startswith": "e"}, "condition": "s and t"}},
        {"id": "C", "title": "C", "logsource": {}, "detection": {"s": {"missing": ""}, "condition": "s"}},
    ] + [
        {"id": c, "title": c, "level": "low", "logsource": {}, "detection": {
            "s": {"user": ["amy", "bob"], "host": "h1"}, "t": {"cmd|contains": "evil"}, "t2": {"cmd|contains": ["bad", "evil"]}, "condition": c}}
        for c in ("s and not t", "not s", "not nosuch", "t or s and not t2", "1 of t*", "all of t*", "all of x*", "nosuch", "s and t or not t2")
    ]
    records = [
        {"event_type": "process_creation", "cmd": "evil bad", "user": "Bob", "host": "h1"},
        {"event_type": "process_creation", "cmd": "bad", "user": "amy", "host": "h1"},
        {"event_type": "dns_query", "cmd": "evil", "user": "bob", "host": "h2"},
    ]
    events = normal(spark, records)
    table = {tuple(r) for r in sigma.match_rule_table(events, rules).collect()}
    columns = {
        (r.rule_id, r.trigger_seq, r.severity) for r in detect(events, sigma.load_rules(texts=rules)).collect()
    }
    assert table == columns and ("A", 0, "High") in table and ("s and not t", 1, "Low") in table
    errors = {}
    bad = [{"title": "no condition", "logsource": {}, "detection": {"s": {"a": "b"}}}, {"id": "L", "title": "L", "logsource": {}, "detection": {"s": ["x"], "condition": "s"}}, "text"]
    assert {tuple(r) for r in sigma.match_rule_table(events, rules + bad, errors).collect()} == table and len(errors) == 3
    with pytest.raises(sigma.SigmaError):
        sigma.match_rule_table(events, bad[:1])
    assert sigma.match_rule_table(events, []).count() == 0


# --- custom rules ----------------------------------------------------------------------


def test_custom_rules(spark):
    def evaluate(event, context):
        return ("Low", [f"{len(context)} in window"]) if len(context) >= 3 else None

    burst = context_rule("MY-BURST", "Burst", evaluate, keys=["host"], columns=["user"], window_secs=3)
    odd_user = StatelessRule("MY-USER", "User", branches=(Branch(F.col("user") == "root", "Info", F.array(F.lit("root"))),))
    users = LevelRule(
        "MY-USERS", "Users", measure="distinct", keys=(F.col("host"),), member=F.lit(True), trigger=F.lit(True),
        value=F.col("user"), fires=lambda n, c: n >= 2, evidence=lambda n, c: F.array(n.cast("string")), severity="Low",
    )
    broken = StatelessRule("MY-BAD", "Bad", branches=(Branch(F.col("no_such_column") == 1, "Low", F.array(F.lit("x"))),))
    records = [{"event_type": "x", "host": "a", "user": u} for u in ("u", "u", "u", "root", "u")]
    rules = RuleSet([burst, odd_user, users, broken])
    rows = detect(normal(spark, records), rules).collect()
    got = {}
    for r in rows:
        got.setdefault(r.rule_id, []).append((r.trigger_seq, r.evidence[0]))
    assert sorted(got["MY-BURST"]) == [(2, "3 in window"), (3, "4 in window"), (4, "4 in window")]
    assert got["MY-USER"] == [(3, "root")]
    assert sorted(got["MY-USERS"]) == [(3, "2"), (4, "2")]
    assert list(rules.errors) == ["MY-BAD"]
    with pytest.raises(AnalysisException):
        detect(normal(spark, records), [broken, odd_user])  # nobody could read what is recorded
    with pytest.raises(Exception):
        detect(normal(spark, records), rules, strict=True)
    assembled = rule_set(sigma.load_rules(texts=["bad"]), [odd_user], disabled=["PS-LATERAL-001"])
    assert len(assembled) == len(builtin_rules()) and assembled.errors


def test_batch_rules_over_short_buckets(spark):
    """Windows that reach over many buckets give what one bucket gives; one call per bucket, silent stretches included."""
    rows = [(f"e{i}", i, (i * 37 % 211) * 1_000_000, f"h{i % 2}" if i % 9 else None, "x", i * 5 % 17) for i in range(180)]
    frame = spark.createDataFrame(rows, "event_id string, seq bigint, us bigint, host string, event_type string, amount bigint")

    def heavy(windows):
        total, sizes = windows.sums(windows.rows["amount"].to_numpy()), windows.sizes
        fired = (total > 60).nonzero()[0]
        return fired, ["Low"] * len(fired), [[f"{sizes[i]} of {total[i]}"] for i in fired]

    for window, bucket in ((24, 3), (24, None), (24, 100), (0, 5)):
        rule = batch_rule("MY-SUM", "Sum", heavy, keys=["host"], columns=["amount"], bucket_secs=bucket)
        got = {r.seq: (r.severity, r.event_ids, r.evidence) for r in rule.find(frame, window).collect()}
        want = {}
        for name, seq, us, host, _, _ in rows:
            inside = [r[5] for r in rows if r[3] == host and us - window * 1_000_000 <= r[2] and (r[2], r[1]) <= (us, seq)]
            if host and sum(inside) > 60:
                want[seq] = ("Low", [name], [f"{len(inside)} of {sum(inside)}"])
        assert got == want
    assert not want  # a window of nothing but the event itself
    assert rule.find(frame.where("false"), 24).count() == 0


def test_failing_jobs_and_broken_built_ins_raise(spark):
    def job(events, window_secs):
        return events.select(F.raise_error(F.lit("lost"))).collect()

    with pytest.raises(PySparkException):
        detect(normal(spark, [{"event_type": "x", "host": "a"}]), RuleSet([FrameRule("MY-JOB", "Job", find=job)]))
    own = next(r for r in builtin_rules() if isinstance(r, FrameRule))
    gone = FrameRule(own.rule_id, own.name, find=lambda events, window_secs: events.select("no_such_column"))
    with pytest.raises(AnalysisException):
        detect(normal(spark, [{"event_type": "x", "host": "a"}]), RuleSet([gone]))


def test_sinks(spark, tmp_path):
    events = normal(spark, [SHELL])
    found = detect(events)
    report.write_detections(found, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1
    report.write_events(events, str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    assert stored.columns[-2:] == ["event_type", "day"] and detect(stored).count() == 1
    report.write_report(report.report_header(events, found), found, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "detections")).first().rule_id == "EXEC-ENCODE-001"
    days = report.host_day_score(found).collect()
    assert [(d.host, d.detections, d.score, d.threat_level) for d in days] == [("WS1", 1, 30, "SUSPICIOUS")]


# --- the index of rule words -----------------------------------------------------------


def many_rules(n):
    """Rules of the usual shapes, each about words of its own."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    out = []
    for i in range(n):
        sets = {"s": {"cmd|contains": [word(), word()], "user": word()}, "t": {"cmd|endswith": word()}, "u": {"host|startswith": word()}}
        out.append({"id": f"R{i}", "title": f"R{i}", "level": "low", "logsource": {}, "detection": sets | {"condition": ("s and not t or u", "1 of s*", "t or u")[i % 3]}})
    return out


def test_an_event_touches_only_rules_with_its_words():
    rules = many_rules(1500)
    tests, rows = sigma.rule_data(rules)
    index = RuleIndex(tests, rows)
    fields = list(tests)
    place = fields.index("cmd")
    event = [""] * len(fields)
    event[place] = "run something else"
    assert index.candidates(event) == {}
    words = rules[7]["detection"]["t"]["cmd|endswith"]
    event[place] = f"run {words}"
    assert set(index.candidates(event)) == {7}
    event[place] = f"{words} run"
    assert index.candidates(event) == {}


def test_rule_index_equals_reading_every_rule():
    """Words that lie in each other, at both ends, empty ones, and conditions that hold without any set."""
    rng = random.Random(2)
    words = ["", "a", "ab", "b", "ba", "abab", "bb"]
    keys = ["x|contains", "x|startswith", "x|endswith", "x", "y|contains", "y"]
    conditions = ["s", "not s", "s and t", "s or not t", "1 of *", "all of *", "not s and not t", "t and not s", "nosuch", "not nosuch"]
    rules = [
        {"id": str(i), "title": "r", "logsource": {"category": rng.choice(["process_creation", "nothing"])}, "detection": {
            **{n: {k: rng.sample(words, rng.randrange(3)) for k in rng.sample(keys, rng.randrange(3))} for n in "st"}, "condition": rng.choice(conditions)}}
        for i in range(400)
    ]
    tests, rows = sigma.rule_data(rules)
    index = RuleIndex(tests, rows)

    def holds(key, value, event):
        field, _, how = key.partition("|")
        text = event[field]
        test = {"contains": text.__contains__, "startswith": text.startswith, "endswith": text.endswith, "": text.__eq__}[how]
        return any(test(w) for w in value)

    def fires(rule, kind, event):
        sets = {n: all(holds(k, v, event) for k, v in f.items()) for n, f in rule["detection"].items() if n != "condition"}
        known = lambda n: sets.get(n, False)
        return (rule["logsource"]["category"] == "nothing" or kind == "process_creation") and {
            "1 of *": any(sets.values()), "all of *": all(sets.values()), "s": known("s"), "not s": not known("s"), "s and t": known("s") and known("t"),
            "s or not t": known("s") or not known("t"), "not s and not t": not known("s") and not known("t"), "t and not s": known("t") and not known("s"),
            "nosuch": False, "not nosuch": True,
        }[rule["detection"]["condition"]]

    for _ in range(300):
        event = {f: "".join(rng.choice("ab") for _ in range(rng.randrange(6))) for f in "xy"}
        kind = rng.choice(["process_creation", "dns_query", None])
        want = [i for i, r in enumerate(rules) if fires(r, kind, event)]
        assert index.fired(kind, [event[f] for f in tests]) == want
