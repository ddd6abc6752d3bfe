"""Sources and normalisation on hand-made records."""

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from eventloom.operators.normalize import is_json, is_shallow, json_object, json_text, normalize, with_flat_map
from eventloom.sources.failures import file_status, source_failures
from eventloom.sources.lines import bad_json_lines, json_records, number_repeats, read_json_events, read_lines, read_syslog_events
from eventloom.sources.packets import decode_packets, packet_records
from eventloom.sources.union import read_sources, union_records
from eventloom.sources.winlog import flatten_records, read_winlog_events

def received():
    return F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("seq"))


def raw_frame(spark, records):
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "seq bigint, value string").withColumn("file", F.lit("mem"))


def events(spark, records, **options):
    out = normalize(json_records(raw_frame(spark, records), received()), **options)
    return {r.seq: r for r in out.collect()}


def test_json_validity(spark):
    cases = {
        '{"a":1}': True, "{}": True, "5": True, '"x"': True, "null": True, "[1,2]": True, '[{"a":1}]': True,
        '{"a":1,"a":2}': True, '{"a":1} junk': False, '{"a":1}{"b":2}': False, '{"a":1},{"b":2}': False,
        "{bad": False, '{"a":1}]': False, '{"a":1}] tail': False, "1} tail": False, '[{"a":1,"a":{"b":NaN}}]': False, '[{"a":1,"a":2}]': True,
         "{'a':1}": False, '{"a":NaN}': False, '{"a":01}': False, "1,2": False, "": False,
    }
    df = spark.createDataFrame([(c,) for c in cases], "raw string")
    got = {r.raw: r.ok for r in df.select("raw", is_json(F.col("raw")).alias("ok")).collect()}
    assert got == cases


def test_json_lines_file(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('\n// note\n  {"event_type":"login_failure","host":"A"}  \n{broken\n5\n{"host":"B"}\n')
    out = read_json_events(spark, str(path), received_at=received())
    got = out.orderBy("seq").collect()
    assert [r.raw for r in got] == ['{"event_type":"login_failure","host":"A"}', "5", '{"host":"B"}']
    assert got[0].source.kind == "json" and got[0].source.name == str(path)
    assert [r.value for r in bad_json_lines(read_lines(spark, str(path))).collect()] == ["{broken"]
    normal = {r.seq: r for r in normalize(out).collect()}
    assert sorted((r.event_type, r.event_type_raw) for r in normal.values()) == [
        ("login_failure", None), ("unknown", "unclassified"), ("unknown", "unclassified"),
    ]


def test_missing_and_empty(spark, tmp_path):
    empty = tmp_path / "empty.json"
    empty.write_text("")
    assert read_json_events(spark, str(empty)).count() == 0
    missing = str(tmp_path / "none.json")
    with pytest.raises(Exception):
        read_json_events(spark, missing).count()
    assert read_json_events(spark, [missing, str(empty)], ignore_missing=True).count() == 0
    with pytest.raises(ValueError):
        read_sources(spark)


def test_unreadable_files(spark, tmp_path):
    lines = "".join(f'{{"event_type":"login_failure","n":{i * 7919 % 100_003}}}\n' for i in range(20_000)).encode()
    packed = gzip.compress(lines)
    files = {
        "good.json.gz": packed, "two.json.gz": packed + packed, "cut.json.gz": packed[: len(packed) // 2], "no.json.gz": b"not packed\n",
        "plain.json": lines, "open.json": b'{"a":1}\r\n{"a":2}', "marked.json": b'\xef\xbb\xbf{"a":1}\n', "empty.json": b"", "x.json.lz4": b"?",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    none = str(tmp_path / "none.json")
    paths = [f"{tmp_path}/*.json*", none]
    want = {
        "good.json.gz": "ok", "two.json.gz": "ok", "cut.json.gz": "incomplete", "no.json.gz": "incomplete", "plain.json": "ok",
        "open.json": "ok", "marked.json": "ok", "x.json.lz4": "unchecked", "none.json": "missing",
    }
    for bound in (1 << 28, 1000):  # the smaller bound makes every packed file a read of its own
        got = {r.file.rsplit("/", 1)[1]: r.status for r in file_status(spark, paths, content_bytes=bound).collect()}
        assert got == want
    assert {r.file.rsplit("/", 1)[1] for r in source_failures(spark, paths).collect()} == {"cut.json.gz", "no.json.gz", "none.json"}
    assert file_status(spark, [none]).collect() == [(none, None, "missing")]
    two = [str(tmp_path / "cut.json.gz"), str(tmp_path / "plain.json")]
    with pytest.raises(Exception):
        read_lines(spark, two).count()
    kept = {r.file.rsplit("/", 1)[1]: r["count"] for r in read_lines(spark, two, skip_unreadable=True).groupBy("file").count().collect()}
    assert kept["plain.json"] == 20_000 and 0 < kept["cut.json.gz"] < 20_000
    assert read_sources(spark, json=[two[1]], skip_unreadable=True, content_ids=True).count() == 20_000


def test_marks_and_depth(spark):
    """U+0001 and U+0002 in keys at every level, and braces inside texts."""
    def nested(depth, key, value="v"):
        record = {key: value, "b": "2"}
        for _ in range(depth):
            record = {"n": record}
        return json.dumps(record)

    keys = ["g\x01h", "\x01cmd", "\x01x\x01cmd", "\x02a", "\x02b\x01\x02", "\x01", "", "\x01\x02a"]
    cases = [(depth, key) for depth in (0, 4, 5, 6, 8) for key in keys]
    got = events(spark, [nested(d, k) for d, k in cases])
    for i, (depth, key) in enumerate(cases):
        want = {k: v for name, v in ((key, "v"), ("b", "2")) for k in ("n." * depth + name, name)}
        assert got[i].metadata == want, (depth, key)
    path = '{"a":{"k\\u0001":{"":{"":{"":{"":{"":{"x\\u0001cmd":"v"}}}}}}}}'
    assert events(spark, [path])[0].metadata == {"a.k\x01......x\x01cmd": "v", "x\x01cmd": "v"}
    script = json.dumps({"script": "{" * 50 + '\\"{', "o": [{"a": {}}] * 9, "n": {"m": 1}})
    shapes = {script: True, nested(5, "k"): True, nested(6, "k"): False, '{"a":"\\\\","b":' + nested(6, "k") + "}": False}
    frame = spark.createDataFrame([(s,) for s in shapes], "raw string")
    assert {r.raw: r.ok for r in frame.select("raw", is_shallow(F.col("raw")).alias("ok")).collect()} == shapes
    assert events(spark, [script])[0].metadata == {"script": "{" * 50 + '\\"{', "n.m": "1", "m": "1"}


def test_syslog(spark, tmp_path):
    path = tmp_path / "s.log"
    path.write_text('Jan 1 su: "root" failed\n\n{"event_type":"login_failure","host":"Z"}\n// kept\n')
    out = normalize(read_syslog_events(spark, str(path), default_host="gw", received_at=received())).orderBy("seq").collect()
    assert [(r.event_type, r.event_type_raw, r.host) for r in out] == [
        ("unknown", "syslog", "gw"), ("login_failure", None, "Z"), ("unknown", "syslog", "gw"),
    ]
    assert out[0].metadata["raw"] == 'Jan 1 su: "root" failed'
    assert (out[0].source.kind, out[0].source.name, out[0].source.facility) == ("syslog", "gw", 1)


def test_types_and_severity(spark):
    got = events(spark, [
        {"event_type": "dns_query", "EventID": 1},
        {"event_type": "odd"},
        {"event_type": 7, "EventID": 4625},
        {"EventID": 4688}, {"EventID": 9999}, {"EventID": "1"}, {"EventID": -1}, {"EventID": 1.0},
        {"severity": "CRITICAL", "Level": 3}, {"severity": "bogus", "Level": 1}, {"Level": 2}, {"Level": 5},
        {"Level": "1"}, {"Level": 9},
    ])
    assert [(got[i].event_type, got[i].event_type_raw) for i in range(8)] == [
        ("dns_query", None), ("unknown", "odd"), ("login_failure", None), ("process_creation", None),
        ("unknown", "EventID:9999"), ("unknown", "unclassified"), ("unknown", "unclassified"), ("unknown", "unclassified"),
    ]
    assert [got[i].severity for i in range(8, 14)] == ["Critical", "Info", "High", "Low", "Info", "Info"]
    assert got[8].severity_rank == 4
    assert events(spark, [{"Level": "1"}], numeric_level_text=True)[0].severity == "Critical"


def test_timestamps(spark):
    got = events(spark, [
        {"timestamp": "2024-01-15T10:29:50Z"},
        {"timestamp": "bad", "time": "2024-01-15T12:29:50.123456789+02:00"},
        {"timestamp": "2024-01-15", "@timestamp": "2024-01-15T10:29:50"},
        {"timestamp": 17},
        {"timestamp": "2024-01-15t10:29:50z"},
        {"timestamp": "2024-13-15T10:29:50Z"},
    ])
    base = 1_705_314_590_000_000
    assert got[0].us == base and got[1].us == base + 123456 and got[4].us == base
    assert [got[i].us for i in (2, 3, 5)] == [1_700_000_000_000_000 + i for i in (2, 3, 5)]


def test_flatten(spark):
    cases = [
        ('{"a":1.0,"b":12345678901234567890123,"c":true,"d":null,"e":"x"}',
         {"a": "1.0", "b": "12345678901234567890123", "c": "true", "e": "x"}),
        ('{"m":{"cmd":"x","pid":7,"n":null,"deep":{"z":false}},"t":1}',
         {"m.cmd": "x", "m.pid": "7", "m.deep.z": "false", "cmd": "x", "pid": "7", "z": "false", "t": "1"}),
        ('{"m":{"k":"nested","a.b":"1"},"k":"top","l":[1,"q",null,{"x":1},[2]],"o":{"l":["s"]},"none":[null]}',
         {"m.k": "nested", "m.a.b": "1", "a.b": "1", "k": "top", "l": "1,q", "o.l": "s"}),
        ('{"b":{"k":"2"},"a":{"k":"1"},"s":"{\\"not\\":\\"parsed\\"}"}',
         {"b.k": "2", "a.k": "1", "k": "1", "s": '{"not":"parsed"}'}),
        ("[1]", {}), ("5", {}), ("{}", {}),
        ('{"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}}}', {"a.b.c.d.e.f.g": "1", "g": "1"}),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, raw string").withColumn("raw", json_text(F.col("raw")))
    got = {r.i: r.m for r in with_flat_map(df.withColumn("top", json_object(F.col("raw"))), "raw", "top", "m").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_aliases(spark):
    got = events(spark, [
        {"CommandLine": "b", "command_line": "a", "Image": "i", "Computer": "C", "hostname": "h"},
        {"cmd": "own", "command_line": "other", "bytes_sent": 12, "SourcePort": "9"},
        {"metadata": {"cmd": "nested", "pid": 5}, "destinationip": "1.2.3.4"},
    ])
    assert (got[0].cmd, got[0].exe, got[0].host) == ("a", "i", "h")
    assert got[0].metadata["cmd"] == "a" and got[0].metadata["CommandLine"] == "b"
    assert (got[1].cmd, got[1].bytes_out, got[1].metadata["src_port"]) == ("own", "12", "9")
    assert (got[2].cmd, got[2].pid, got[2].dst_ip) == ("nested", "5", None)
    assert events(spark, [{"destinationip": "1.2.3.4"}], extended_aliases=True)[0].dst_ip == "1.2.3.4"


def test_host_filter(spark):
    records = [{"host": "Web1"}, {"host": "db"}, {"x": 1}, {"Computer": "WEB1"}]
    assert sorted(events(spark, records, hosts=["wEb1"])) == [0, 3]
    assert len(events(spark, records)) == 4


def test_ids_are_stable(spark):
    a, b = (events(spark, [{"host": "x"}, {"host": "x"}]) for _ in range(2))
    assert a[0].event_id == b[0].event_id and a[0].event_id != a[1].event_id


SYSTEM = {"EventID": 4625, "Channel": "Security", "Computer": "PC1", "Level": 2,
          "TimeCreated": {"#attributes": {"SystemTime": "2024-01-15T10:29:50Z"}}}


def test_windows_records(spark, tmp_path):
    shapes = [
        {"Event": {"System": SYSTEM, "EventData": {"Data": [
            {"#attributes": {"Name": "IpAddress"}, "#text": "10.0.0.9"},
            {"#attributes": {"Name": "SourceAddress"}, "#text": "lost"},
            {"#attributes": {"Name": "LogonType"}, "#text": "3"},
            {"#attributes": {"Name": "Count"}, "#text": 3}, "loose"]}}},
        {"Event": {"System": {**SYSTEM, "EventID": {"#text": "1"}, "Level": "4"},
                   "EventData": {"Data": {"CommandLine": "whoami", "ProcessId": 12, "Flag": True}}}},
        {"Event": {"System": {"EventID": "x"}, "EventData": {"Image": "a.exe", "DestPort": 445, "Host": "own"}}},
        {"event_type": "dns_query", "host": "plain"},
        {"Event": None},
    ]
    path = tmp_path / "w.json"
    path.write_text("\n".join(json.dumps(s) for s in shapes))
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)], "i int, raw string")
    flat = {r.i: json.loads(r.f) for r in flatten_records(df, "raw", "f").collect()}
    head = {"channel": "Security", "host": "PC1", "timestamp": "2024-01-15T10:29:50Z"}
    assert flat[0] == {"EventID": 4625, **head, "Level": "2", "source_ip": "10.0.0.9", "logontype": "3"}
    assert flat[1] == {"EventID": 1, **head, "Level": "4", "cmd": "whoami", "pid": "12"}
    assert flat[2] == {"image": "a.exe", "dst_port": "445", "host": "own"}
    assert flat[3] == shapes[3] and flat[4] == {}
    got = normalize(read_winlog_events(spark, str(path), received_at=received())).orderBy("seq").collect()
    assert [r.event_type for r in got] == ["login_failure", "process_creation", "unknown", "dns_query", "unknown"]
    assert (got[0].severity, got[0].source.kind, got[0].us) == ("Info", "evtx", 1_705_314_590_000_000)


# --- packets ---------------------------------------------------------------------------

SRC, DST = bytes([10, 0, 0, 1]), bytes([8, 8, 4, 4])


def ether(kind, body, vlans=0):
    tags = b"".join(struct.pack(">HH", 0x8100, 5) for _ in range(vlans))
    return b"\x01" * 12 + tags + struct.pack(">H", kind) + body


def ipv4(proto, body, options=b"", fragment=0):
    size = 20 + len(options) + len(body)
    head = struct.pack(">BBHHHBBH", 0x45 + len(options) // 4, 0, size, 0, fragment, 64, proto, 0)
    return head + SRC + DST + options + body


def ipv6(proto, body):
    return struct.pack(">IHBB", 0x60000000, len(body), proto, 64) + bytes(range(16)) + bytes(range(16, 32)) + body


def tcp(src, dst, body=b""):
    return struct.pack(">HHIIBBHHH", src, dst, 0, 0, 0x50, 0, 0, 0, 0) + body


def udp(src, dst, body=b""):
    return struct.pack(">HHHH", src, dst, 8 + len(body), 0) + body


def question(*labels):
    return b"\x00" * 12 + b"".join(bytes([len(x)]) + x for x in labels) + b"\x00\x00\x01\x00\x01"


V4 = ("10.0.0.1", "8.8.4.4")
V6 = ("0001:0203:0405:0607:0809:0a0b:0c0d:0e0f", "1011:1213:1415:1617:1819:1a1b:1c1d:1e1f")
NONE = (None, None)
PACKETS = [
    (ether(0x0800, ipv4(6, tcp(1000, 443, b"x"))), ("network_connection", "tcp", *V4, "1000", "443", None)),
    (ether(0x0800, ipv4(6, tcp(1000, 80), options=b"\0" * 8), vlans=1), ("network_connection", "tcp", *V4, "1000", "80", None)),
    (ether(0x0800, ipv4(17, udp(5, 53, question(b"www", b"example", b"com"))), vlans=2), ("dns_query", "udp", *V4, "5", "53", "www.example.com")),
    (ether(0x0800, ipv4(17, udp(53, 5, b"\0" * 5))), ("dns_query", "udp", *V4, "53", "5", "")),
    (ether(0x0800, ipv4(17, udp(53, 5, question(b"ab")[:14]))), ("dns_query", "udp", *V4, "53", "5", "")),
    (ether(0x0800, ipv4(17, udp(53, 5, question(b"\xff\xfe")))), ("dns_query", "udp", *V4, "53", "5", "")),
    (ether(0x0800, ipv4(17, udp(53, 5, b"\0" * 12 + b"\x02ab\xc0\x0c"))), ("dns_query", "udp", *V4, "53", "5", "ab")),
    (ether(0x86DD, ipv6(17, udp(9, 10))), ("network_connection", "udp", *V6, "9", "10", None)),
    (ether(0x86DD, ipv6(58, b"\x80\0\0\0")), ("network_connection", "ipv6", *V6, *NONE, None)),
    (ether(0x0800, ipv4(1, b"\x08\0\0\0")), ("network_connection", "ipv4", *V4, *NONE, None)),
    (ether(0x0800, ipv4(6, b"\0" * 8, fragment=0x2000)), ("network_connection", "ipv4", *V4, *NONE, None)),
    (ether(0x0806, b"\0" * 28), ("network_connection", "unknown", *NONE, *NONE, None)),
    (b"\x01" * 9, ("network_connection", "raw", *NONE, *NONE, None)),
    (ether(0x0800, ipv4(6, tcp(1, 2))[:30]), ("network_connection", "raw", *NONE, *NONE, None)),
    (ether(0x0800, ipv4(6, b"\0" * 8)), ("network_connection", "raw", *NONE, *NONE, None)),
]


def test_packets(spark):
    df = spark.createDataFrame(
        [(i, bytearray(data)) for i, (data, _) in enumerate(PACKETS)], "seq bigint, data binary"
    ).withColumn("ts", F.timestamp_micros(F.col("seq") + 5))
    got = {r.seq: r for r in decode_packets(df).collect()}
    names = ["event_type", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "query"]
    for i, (_, want) in enumerate(PACKETS):
        assert tuple(got[i][n] for n in names) == want, i
    normal = {r.seq: r for r in normalize(packet_records(df, "eth0")).collect()}
    assert normal[2].query == "www.example.com" and normal[2].source_ip == "10.0.0.1" and normal[2].us == 7
    assert normal[2].host is None and normal[2].source.kind == "pcap"


def test_union_keeps_arrivals_apart(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text('{"host":"x"}\n{"host":"y"}\n')
    (tmp_path / "s.log").write_text("free text\n")
    out = read_sources(
        spark, json=[str(tmp_path / "a.json"), str(tmp_path / "b.json")], syslog=[str(tmp_path / "s.log")]
    )
    assert out.count() == 5 and out.select("seq").distinct().count() == 5


def test_union_of_twenty_inputs_keeps_their_order(spark):
    frame = spark.range(3).select(F.col("id").alias("seq"), F.lit("x").alias("raw"))
    parts = [frame.withColumn("raw", F.lit(str(i))) for i in range(20)]
    got = [(r.raw, r.seq) for r in union_records(parts).orderBy("seq").collect()]
    assert [int(k) for k, _ in got] == [i for i in range(20) for _ in range(3)] and len({s for _, s in got}) == 60
    with pytest.raises(Exception, match="does not fit"):
        union_records([frame, frame.withColumn("seq", F.lit(1 << 62))]).collect()


def test_repeated_keys_and_any_depth(spark):
    deep = '{"cmd":"deep","n":1.50,"list":["x",{"y":1},null,2],"z":{},"v":null}'
    for key in "gfedcba":
        deep = f'{{"{key}":{deep}}}'
    records = [
        '{"host":"a","host":"b"}', '{"x":1,"event_type":"dns_query","x":2}', '{"host":"a","host":"b","n":{"z":1}}', '{"n":{"b":1,"b":2}}', deep,
    ]
    got = events(spark, records)
    assert got[0].host == "b" and got[1].event_type == "dns_query" and got[1].metadata["x"] == "2"
    assert got[2].host == "b" and got[2].metadata["z"] == "1" and got[3].metadata["n.b"] == "2"
    path = "a.b.c.d.e.f.g"
    assert got[4].cmd == "deep" and got[4].metadata[f"{path}.cmd"] == "deep" and got[4].metadata[f"{path}.n"] == "1.5"
    assert got[4].metadata[f"{path}.list"] == "x,2" and not any(v.startswith("{") for v in got[4].metadata.values())
    twice = '{"Event":{"System":{"EventID":4625,"EventID":4624,"Computer":"PC1"},"EventData":{"IpAddress":"1.2.3.4","IpAddress":"5.6.7.8"}}}'
    row = normalize(winlog_of(spark, [twice])).collect()[0]
    assert (row.event_type, row.host, row.source_ip) == ("login_success", "PC1", "5.6.7.8")


def winlog_of(spark, records):
    from eventloom.sources.winlog import winlog_records

    return winlog_records(raw_frame(spark, records), received())


def test_ids_do_not_depend_on_splits(spark, tmp_path):
    path = tmp_path / "many.json"
    path.write_text("".join(f'{{"event_type":"login_failure","host":"h{i % 7}"}}\n' for i in range(3000)))
    ids = []
    for size in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        raw = number_repeats(read_json_events(spark, str(path), received_at=received()))
        ids.append(sorted(r.event_id for r in normalize(raw).select("event_id").collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids[0] == ids[1] and len(set(ids[0])) == 3000


def test_json_lines_are_read_once(spark):
    from eventloom.sources.lines import json_lines, syslog_records

    texts = ["click", "true", " null ", "nullx", "tru", "1 2", "-1", '{"a":1}', '{"a":1} x', '{"a":1,"a":2}', "[1],[2]", '"s"', "", "// x", "﻿{}", "NaN", "'a'", "\n[1]\r", "1}", '1,"k":2', '{"a":NaN}']
    table = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "seq long, value string, file string")
    want = {1: "true", 2: " null ", 6: "-1", 7: '{"a":1}', 9: '{"a":2}', 11: '"s"', 17: "\n[1]\r"}
    out = json_lines(table)
    assert {r.seq: r.value for r in out.collect()} == want
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    raw = syslog_records(table, "gw", F.current_timestamp()).collect()
    assert {r.seq: r.raw for r in raw if r.seq in want} == want and len(raw) == len(texts) - 1
    assert all(r.raw.startswith('{"event_type":"syslog"') for r in raw if r.seq not in want)
