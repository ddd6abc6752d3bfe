"""SQL that computes the registered queries in another engine, written from the definitions
(window frames, self joins, CASE) and not from the sweeps the DataFrame side uses."""

from __future__ import annotations

from eventloom import fixed_values as V
from eventloom.driver_view import VIEW_SQL, WINDOW_SECS

W = WINDOW_SECS * 1_000_000
FRAME = f"RANGE BETWEEN {W} PRECEDING AND CURRENT ROW"
CMD = "lower(coalesce(cmd, ''))"
PL = "event_type IN ('process_creation', 'command_execution')"
HU = "'Host: ' || host || '  |  User: ' || \"user\""
HUP = HU + " || '  |  PID: ' || coalesce(pid, '?')"
COMMAND = f"'Command: ' || {CMD}"
WEIGHT = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in V.SEVERITY_WEIGHT.items()) + " END"
LEVEL = "CASE " + " ".join(f"WHEN score >= {f} THEN '{n}'" for f, n in V.THREAT_BANDS) + " END"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(text, words):
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def has_all(text, words):
    return "(" + " AND ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def ends(text, words):
    return "(" + " OR ".join(f"suffix({text}, {q(w)})" for w in words) + ")"


def first(text, words):
    return "CASE " + " ".join(f"WHEN contains({text}, {q(w)}) THEN {q(w)}" for w in words) + " END"


def every(words):
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN contains({CMD}, {q(w)}) THEN {q(w)} END" for w in words) + ")"


def with_view(body: str, extra: str = "") -> str:
    return f"WITH {VIEW_SQL}{', ' + extra if extra else ''} {body}"


def rows(rule_id: str, source: str, where: str, severity: str, *lines: str) -> str:
    text = "concat_ws('; ', " + ", ".join(lines) + ")"
    return (
        f"SELECT rule_id, seq, severity, CAST({WEIGHT} AS BIGINT) AS score, evidence FROM ("
        f"SELECT {q(rule_id)} AS rule_id, seq, {severity} AS severity, {text} AS evidence FROM {source} WHERE {where})"
    )


def command(rule_id, severity, where, *lines, types=PL):
    return rows(rule_id, "ev", f"{types} AND ({where})", q(severity), *lines)


PC = "event_type = 'process_creation'"
NET = "event_type = 'network_connection'"
PATH = "lower(coalesce(file_path, ''))"
KEY = "lower(coalesce(registry_key, ''))"
PARENT = "lower(coalesce(parent_image, ''))"
CALL = f"(' ' || {CMD})"
TOOL = f"({CMD} || ' ' || {PARENT})"
SERVICE = "lower(coalesce(service_name, ''))"


def counted(keys: str, members: str, rest: str = "") -> str:
    return f"(SELECT *, count(*) OVER (PARTITION BY {keys} ORDER BY us {FRAME}) AS n FROM ev WHERE {members}{rest})"


def distinct(keys: str, value: str, members: str) -> str:
    return (
        f"(SELECT *, count(DISTINCT {value}) OVER (PARTITION BY {keys} ORDER BY us {FRAME}) AS n"
        f" FROM ev WHERE {members})"
    )


def nth(n: int) -> str:
    return f"n >= {n} AND n % {n} = 0"


N = "CAST(n AS VARCHAR)"
FAILURE = "event_type = 'login_failure'"
DISCOVERY = f"{PL} AND {has(CMD, V.DISCOVERY_COMMANDS)}"
RANSOM = f"event_type = 'file_creation' AND {ends(PATH, V.RANSOM_SUFFIXES)}"
SUMMED = (
    "(SELECT *, CAST(sum(bytes) OVER (PARTITION BY host ORDER BY us "
    f"{FRAME}) AS BIGINT) AS n FROM ev WHERE {NET})"
)
FAILED = (
    "(SELECT s.*, (SELECT count(*) FROM ev f WHERE f.event_type = 'login_failure' AND f.host = s.host"
    f" AND f.source_ip = s.source_ip AND f.us BETWEEN s.us - {W} AND s.us) AS n"
    " FROM ev s WHERE s.event_type = 'login_success')"
)
PRECEDED = (
    f"(SELECT r.*, EXISTS (SELECT 1 FROM ev p WHERE p.event_type = 'process_creation' AND p.us BETWEEN r.us - {W} AND r.us)"
    " AS found FROM ev r WHERE r.event_type = 'registry_modification')"
)
LATERAL_CTE = f"""
t AS (SELECT * FROM ev WHERE event_type = 'service_installation'),
p AS (SELECT * FROM ev WHERE {PC} AND {has(CMD, V.POWERSHELL_NAMES)}),
n AS (SELECT * FROM ev WHERE {NET}),
pw AS (SELECT t.seq, arg_min(p.seq, p.us) AS p_seq FROM t JOIN p ON p.us BETWEEN t.us - {W} AND t.us GROUP BY 1),
nw AS (SELECT t.seq, arg_min(n.seq, n.us) AS n_seq FROM t JOIN n ON n.us BETWEEN t.us - {W} AND t.us GROUP BY 1),
both_before AS (SELECT seq, p_seq, n_seq FROM pw JOIN nw USING (seq)),
triples AS (
  SELECT t.seq, p.seq AS p_seq, n.seq AS n_seq, row_number() OVER (PARTITION BY t.seq ORDER BY
      greatest(t.us, p.us, n.us) - least(t.us, p.us, n.us), abs(p.us - t.us), p.us > t.us, abs(n.us - t.us), n.us > t.us) AS rn
  FROM t JOIN p ON p.us BETWEEN t.us - {W} AND t.us + {W} JOIN n ON n.us BETWEEN t.us - {W} AND t.us + {W}
  WHERE t.seq NOT IN (SELECT seq FROM both_before)
    AND greatest(t.us, p.us, n.us) - least(t.us, p.us, n.us) <= {W}),
chosen AS (SELECT * FROM both_before UNION ALL SELECT seq, p_seq, n_seq FROM triples WHERE rn = 1),
lateral_rows AS (
  SELECT t.seq, t.host, t.us, t.service_name, p.seq AS p_seq, p.cmd AS p_cmd, n.seq AS n_seq, n.dst_ip AS n_ip, n.dst_port AS n_port
  FROM chosen JOIN t ON t.seq = chosen.seq JOIN p ON p.seq = chosen.p_seq JOIN n ON n.seq = chosen.n_seq)
"""


DENSER = 2500  # times of cooccurrence_default_window are divided by this
DISABLED_RULES = ["PS-LATERAL-001", "EXEC-LOLBIN-001", "NET-BEACON-001"]
CLASSIFY_IDS = [*V.EVENT_ID_TYPES, 9999]

# Rules of the sigma_* queries and, under the same name, the predicate they should compile to.
SIGMA_RULES = {
    "contains_list": {
        "title": "contains list", "level": "high", "logsource": {"category": "process_creation"},
        "detection": {"s": {"cmd|contains": ["WHOAMI", "mimikatz"]}, "condition": "s"},
    },
    "selection_and": {
        "title": "selection and", "level": "medium", "logsource": {"category": "network_connection"},
        "detection": {"s": {"dst_port": 445, "dst_ip|startswith": "10.1."}, "condition": "s"},
    },
    "exact_field": {
        "title": "exact field", "level": "low", "logsource": {"service": "logon_failed"},
        "detection": {"s": {"user": ["U7", "u12"]}, "condition": "s"},
    },
    "endswith_not": {
        "title": "endswith not", "level": "critical", "logsource": {"category": "file_event"},
        "detection": {"a": {"file_path|endswith": [".locked", ".exe"]}, "b": {"host": "h3"}, "condition": "a and not b"},
    },
    "or_and": {
        "title": "or and", "logsource": {"category": "unmapped"},
        "detection": {
            "a": {"kind": "error"}, "b": {"host": "h1"}, "c": {"kind": "view"}, "d": {"host": "h2"},
            "condition": "a and b or c and d",
        },
    },
    "one_of": {
        "title": "one of", "level": "high", "logsource": {"category": "dns"},
        "detection": {"q_long": {"query|startswith": "aaaa"}, "q_seven": {"query|contains": "7."}, "condition": "1 of q_*"},
    },
    "all_of": {
        "title": "all of", "level": "high", "logsource": {"category": "registry_set"},
        "detection": {"k_run": {"registry_key|contains": "\\run"}, "k_value": {"registry_value|startswith": "v8"}, "condition": "all of k_*"},
    },
}
SIGMA_SQL = {
    "contains_list": ("High", "ProcessCreation", "event_type = 'process_creation' AND (contains(lower(cmd), 'whoami') OR contains(lower(cmd), 'mimikatz'))"),
    "selection_and": ("Medium", "NetworkConnection", "event_type = 'network_connection' AND dst_port = '445' AND starts_with(dst_ip, '10.1.')"),
    "exact_field": ("Low", "LoginFailure", "event_type = 'login_failure' AND \"user\" IN ('u7', 'u12')"),
    "endswith_not": ("Critical", "FileCreation", "event_type = 'file_creation' AND (suffix(lower(file_path), '.locked') OR suffix(lower(file_path), '.exe')) AND host <> 'H3'"),
    "or_and": ("Info", None, "(kind = 'error' AND host = 'H1') OR (kind = 'view' AND host = 'H2')"),
    "one_of": ("High", "DnsQuery", "event_type = 'dns_query' AND (starts_with(query, 'aaaa') OR contains(query, '7.'))"),
    "all_of": ("High", "RegistryModification", "event_type = 'registry_modification' AND contains(lower(registry_key), '\\run') AND starts_with(registry_value, 'v8')"),
}
# Conditions that only the lenient reading takes: words after the end, a parenthesis as part of a name, "not 1" as a name
# that no set has, "them" as a prefix that none has.
_SETS = {"s": {"kind": "error"}, "t": {"host": "h2"}}
COMPAT_RULES = {
    name: {"title": f"lenient {name}", "level": "low", "logsource": {"category": "unmapped"}, "detection": {**_SETS, "condition": condition}}
    for name, condition in {
        "words_after": "s and t count by host", "parentheses": "(s) or t", "not_one_of": "t and not 1 of s", "of_them": "1 of them or s and t",
    }.items()
}
COMPAT_SQL = {
    "words_after": ("Low", None, "kind = 'error' AND host = 'H2'"),
    "parentheses": ("Low", None, "host = 'H2'"),
    "not_one_of": ("Low", None, "host = 'H2'"),
    "of_them": ("Low", None, "kind = 'error' AND host = 'H2'"),
}
TYPE_LABEL = "CASE event_type " + " ".join(
    f"WHEN '{t}' THEN '{t.title().replace('_', '')}'" for t in V.EVENT_TYPES
) + " END"


def sigma_sql(name: str) -> str:
    severity, label, where = {**SIGMA_SQL, **COMPAT_SQL}[name]
    title = {**SIGMA_RULES, **COMPAT_RULES}[name]["title"]
    shown = q(label) if label else TYPE_LABEL
    return with_view(
        f"SELECT {q('SIGMA-' + title)} AS rule_id, seq, {q(severity)} AS severity, CAST({V.SEVERITY_WEIGHT[severity]} AS BIGINT) AS score,"
        f" {q(f'Sigma rule {chr(39)}{title}{chr(39)} matched on ')} || {shown} AS evidence FROM ev WHERE {where}"
    )


def source_sql() -> dict[str, str]:
    ids = "CASE k % {n} {arms} END".format(
        n=len(CLASSIFY_IDS), arms=" ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(CLASSIFY_IDS))
    )
    types = "CASE id " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in V.EVENT_ID_TYPES.items()) + " ELSE 'unknown' END"
    levels = "CASE k % 7 " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in V.NUMERIC_LEVELS.items()) + " ELSE 'Info' END"
    ranks = "CASE severity " + " ".join(f"WHEN {q(s)} THEN {i}" for i, s in enumerate(V.SEVERITIES)) + " END"
    return {
        "json_flatten_alias": with_view(
            "SELECT seq, 'H' || substr(\"user\", 2) AS host, 'run ' || k AS cmd, kind AS event_type_raw, CAST(k AS VARCHAR) AS data_k,"
            " CAST(k AS VARCHAR) AS k, 'a,' || k AS tags, 'run ' || k AS command, 9 AS fields FROM ev"
        ),
        "classify": with_view(
            f"SELECT seq, us, event_type, event_type_raw, severity, {ranks} AS severity_rank FROM ("
            f"SELECT seq, us, {types} AS event_type, CASE WHEN id = 9999 THEN 'EventID:9999' END AS event_type_raw,"
            f" CASE WHEN k % 3 = 0 THEN 'High' ELSE {levels} END AS severity FROM (SELECT *, {ids} AS id FROM ev0))"
        ),
        "json_lines": with_view("SELECT seq, CASE WHEN k % 5 = 1 THEN 'bad' ELSE 'good' END AS kind FROM ev0 WHERE k % 5 <> 0"),
        "syslog_lines": (
            "SELECT 'gw' AS host, 'unknown' AS event_type, 'syslog' AS event_type_raw, count(*) AS records,"
            " CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE trim(text) <> ''"
        ),
        "windows_records": with_view(
            "SELECT seq, 'login_failure' AS event_type, 'Info' AS severity, 'PC' || substr(host, 2) AS host,"
            " '10.0.0.' || k AS source_ip, 'Security' AS channel, '3' AS logon_type FROM ev"
        ),
        "packets": with_view(
            "SELECT seq, us, CASE WHEN k % 2 = 0 THEN 'dns_query' ELSE 'network_connection' END AS event_type,"
            " '10.0.0.' || k AS source_ip, '8.8.4.4' AS dst_ip, CAST(k + 2000 AS VARCHAR) AS src_port,"
            " CASE WHEN k % 2 = 0 THEN '53' ELSE CAST(CAST(substr(\"user\", 2) AS INTEGER) + 3000 AS VARCHAR) END AS dst_port,"
            " CASE WHEN k % 2 = 0 THEN 'udp' ELSE 'tcp' END AS protocol,"
            " CASE WHEN k % 2 = 0 THEN 'h' || k || '.example.com' END AS query FROM ev"
        ),
    }


def stream_sql() -> dict[str, str]:
    selects = rule_selects()
    stateless = [
        r for r in V.RULE_HEADS
        if r not in (
            "PS-LATERAL-001", "EXEC-RECON-001", "FILE-RANSOM-001", "REG-PERSIST-001", "AUTH-BRUTE-001", "DNS-TUNNEL-001",
            "NET-BEACON-001", "NET-PORTSCAN-001", "NET-SMBLAT-001", "AUTH-SFBRUTE-001", "AUTH-SPRAY-001",
        )
    ]
    # of the transfer rule only the single-transfer branch is stateless
    union = " UNION ALL ".join(f"({selects[r]})" for r in stateless)
    return {
        "stream_stateless_rules": with_view(
            f"SELECT * FROM ({union}) WHERE NOT (rule_id = 'NET-DATAXFR-001' AND severity = 'High')"
        ),
        "stream_trailing_count": with_view(
            f"SELECT seq, n FROM {counted('host', FAILURE)}"
        ),
        "stream_cooccurrence": with_view("SELECT seq FROM chosen", LATERAL_CTE),
        "sigma_rule_table": with_view(
            " UNION ALL ".join(
                f"SELECT '{n}' AS rule_id, seq, {q(SIGMA_SQL[n][0])} AS severity FROM ev WHERE {SIGMA_SQL[n][2]}"
                for n in SIGMA_RULES
            )
        ),
    }


def rule_selects() -> dict[str, str]:
    """Per rule id the SELECT over ``ev`` that lists its firings."""
    pair_or = lambda words, pair: f"{has(CMD, words)} OR {has_all(CMD, pair)}"
    out = {
        "PS-LATERAL-001": rows(
            "PS-LATERAL-001", "lateral_rows", "TRUE", "'Critical'",
            "'PowerShell spawned: ' || p_cmd", "'Outbound connection to ' || n_ip || ':' || n_port",
            "'Service installed: ' || service_name",
        ),
        "CRED-DUMP-001": command(
            "CRED-DUMP-001", "Critical", pair_or(V.CREDENTIAL_DUMP_WORDS, V.CREDENTIAL_DUMP_PAIR),
            f"'Credential dumping indicator: ''' || coalesce({first(CMD, V.CREDENTIAL_DUMP_WORDS)}, 'procdump lsass') || ''''",
            COMMAND, HU, types=PC,
        ),
        "EXEC-LOLBIN-001": command(
            "EXEC-LOLBIN-001", "High", f"{has(CMD, V.LOLBIN_TOOLS)} AND {has(CMD, V.LOLBIN_PATTERNS)}",
            f"'LOLBin ''' || {first(CMD, V.LOLBIN_TOOLS)} || ''' invoked with suspicious pattern ''' || {first(CMD, V.LOLBIN_PATTERNS)} || ''''",
            COMMAND, HUP,
        ),
        "EXEC-ENCODE-001": command(
            "EXEC-ENCODE-001", "High", has(CMD, V.ENCODED_MARKERS),
            f"'Obfuscation patterns matched: ' || {every(V.ENCODED_MARKERS)}", COMMAND, HUP,
        ),
        "SUSP-WMI-001": command(
            "SUSP-WMI-001", "High", f"{has(CMD, V.WMI_TOOLS)} AND {has(CMD, V.WMI_SUBCOMMANDS)}",
            f"'WMI execution sub-command detected: ''' || {first(CMD, V.WMI_SUBCOMMANDS)} || ''''", COMMAND, HU,
        ),
        "SUSP-SCHTASK-001": command(
            "SUSP-SCHTASK-001", "Medium", f"{has(CMD, V.TASK_TOOLS)} AND {has(CMD, V.TASK_SUBCOMMANDS)}",
            f"'Scheduled task created/modified: ' || {CMD}", HU,
        ),
        "ACCOUNT-CREATE-001": command(
            "ACCOUNT-CREATE-001", "High", pair_or(V.ACCOUNT_PATTERNS, V.ACCOUNT_PAIR),
            f"'Account creation command detected: ' || {CMD}", "'Host: ' || host || '  |  Executed by: ' || \"user\"",
        ),
        "EXEC-SHADOW-001": command(
            "EXEC-SHADOW-001", "Critical", pair_or(V.SHADOW_INDICATORS, V.SHADOW_PAIR),
            f"'Backup-inhibit indicator: ''' || coalesce({first(CMD, V.SHADOW_INDICATORS)}, {q(V.SHADOW_PAIR_LABEL)}) || ''''",
            COMMAND, HU,
        ),
        "EXEC-AVDEF-001": command(
            "EXEC-AVDEF-001", "High",
            f"{has(CMD, V.AV_DISABLE_PATTERNS)} OR ({has(CMD, V.SERVICE_ACTIONS)} AND {has(CMD, V.AV_SERVICES)})",
            f"CASE WHEN {has(CMD, V.AV_DISABLE_PATTERNS)} THEN 'AV/EDR disabling cmdlet detected: ''' || {first(CMD, V.AV_DISABLE_PATTERNS)} || ''''"
            f" ELSE 'Security service ''' || {first(CMD, V.AV_SERVICES)} || ''' stopped or disabled' END",
            COMMAND, HU,
        ),
        "EXEC-LOGCLR-001": command(
            "EXEC-LOGCLR-001", "High", has(CMD, V.LOG_CLEAR_PATTERNS),
            f"'Log-clearing pattern matched: ''' || {first(CMD, V.LOG_CLEAR_PATTERNS)} || ''''", COMMAND, HU,
        ),
        "EXEC-RECON-001": rows(
            "EXEC-RECON-001", counted("host", DISCOVERY), nth(V.DISCOVERY_EVERY), "'Medium'",
            f"{N} || ' discovery commands executed from host ''' || host || ''''", f"'Latest: ' || {CMD}", "'User: ' || \"user\"",
        ),
        "EXEC-OFFMAC-001": command(
            "EXEC-OFFMAC-001", "Critical", f"{has(PARENT, V.OFFICE_APPS)} AND {has(CALL, V.OFFICE_CHILDREN)}",
            f"'Office parent: ' || {PARENT}",
            f"'Suspicious child: ''' || {first(CALL, V.OFFICE_CHILDREN)} || '''  →  ' || {CMD}", HU, types=PC,
        ),
        "EXEC-DLCRD-001": command(
            "EXEC-DLCRD-001", "High",
            f"(contains({CMD}, 'certutil') AND {has(CMD, V.CERTUTIL_FLAGS)}) OR ({has(CMD, V.DOWNLOAD_PATTERNS)} AND {has(CMD, V.CRADLE_EXEC_PATTERNS)})",
            f"CASE WHEN contains({CMD}, 'certutil') AND {has(CMD, V.CERTUTIL_FLAGS)} THEN 'certutil used to download or decode a remote file'"
            " ELSE 'Download-and-execute cradle detected (download function + IEX/assembly load)' END",
            COMMAND, HU,
        ),
        "EXEC-PIPE-001": command(
            "EXEC-PIPE-001", "Critical", has(CMD, V.PIPE_INDICATORS),
            f"'Named pipe indicator matched: ''' || {first(CMD, V.PIPE_INDICATORS)} || ''''", COMMAND, HUP,
        ),
        "EXEC-PSEXEC-001": rows(
            "EXEC-PSEXEC-001", "ev",
            f"(event_type = 'service_installation' AND {has(SERVICE, V.REMOTE_EXEC_SERVICES)}) OR ({PL} AND {has(TOOL, V.REMOTE_EXEC_TOOLS)})",
            "'High'",
            f"CASE WHEN event_type = 'service_installation' THEN 'PsExec service installed: ''' || {first(SERVICE, V.REMOTE_EXEC_SERVICES)} || ''''"
            f" ELSE 'Remote execution tool indicator: ''' || {first(TOOL, V.REMOTE_EXEC_TOOLS)} || '''' END",
            f"CASE WHEN event_type <> 'service_installation' THEN {COMMAND} END",
            f"CASE WHEN event_type = 'service_installation' THEN 'Host: ' || host ELSE {HU} END",
        ),
        "FILE-DROP-001": command(
            "FILE-DROP-001", "High", f"{has(PATH, V.STAGING_DIRS)} AND {ends(PATH, V.EXECUTABLE_SUFFIXES)}",
            f"'Executable file created: ' || {PATH}", HU, types="event_type = 'file_creation'",
        ),
        "FILE-RANSOM-001": rows(
            "FILE-RANSOM-001", counted("host", RANSOM), nth(V.RANSOM_EVERY), "'Critical'",
            f"{N} || ' files with ransomware extensions created on ''' || host || ''''",
            f"'Latest encrypted file: ' || {PATH}", "'User: ' || \"user\"",
        ),
        "FILE-ARCEXF-001": command(
            "FILE-ARCEXF-001", "High", f"{has(CMD, V.ARCHIVE_TOOLS)} AND {has(CMD, V.ARCHIVE_DESTINATIONS)}",
            f"'Archive tool used with suspicious destination ''' || {first(CMD, V.ARCHIVE_DESTINATIONS)} || ''''", COMMAND, HU,
        ),
        "REG-PERSIST-001": rows(
            "REG-PERSIST-001", PRECEDED, has(KEY, V.PERSISTENCE_KEYS), "'Medium'",
            f"'Registry key modified: ' || {KEY}", "'Value written: ' || registry_value", HU,
            "CASE WHEN found THEN 'Preceded by a ProcessCreation event in the same correlation window' END",
        ),
        "AUTH-BRUTE-001": rows(
            "AUTH-BRUTE-001", counted("host", "event_type = 'login_failure'"), nth(V.BRUTE_FORCE_EVERY), "'High'",
            f"{N} || ' failed login attempts against host ''' || host || ''' from ' || source_ip",
        ),
        "DNS-TUNNEL-001": rows(
            "DNS-TUNNEL-001", counted("host", "event_type = 'dns_query'"),
            f"strlen(query) > {V.DNS_LONG_BYTES} OR ({nth(V.DNS_EVERY)})", "'High'",
            f"CASE WHEN n >= {V.DNS_EVERY} THEN {N} || ' DNS queries from host ''' || host || ''' within the correlation window' END",
            f"CASE WHEN strlen(query) > {V.DNS_LONG_BYTES} THEN 'Long DNS query name (' || CAST(strlen(query) AS VARCHAR) || ' chars): ' || substring(query, 1, {V.DNS_QUOTED_CHARS}) END",
            "'Resolver: unknown'",
        ),
        "NET-BEACON-001": rows(
            "NET-BEACON-001", counted("host, dst_ip", NET), nth(V.BEACON_EVERY), "'Medium'",
            f"{N} || ' connections from ''' || host || ''' to ' || dst_ip || ':' || dst_port || ' in the correlation window'",
            "'Regular repeated connections suggest automated C2 beaconing'",
        ),
        "NET-PORTSCAN-001": rows(
            "NET-PORTSCAN-001", distinct("host", "dst_port", NET), nth(V.PORT_SCAN_EVERY), "'Medium'",
            f"'Host ''' || host || ''' probed ' || {N} || ' distinct destination ports in the correlation window'",
        ),
        "NET-C2PORT-001": rows(
            "NET-C2PORT-001", "ev",
            f"{NET} AND (dst_port IN ({', '.join(map(q, V.ATTACKER_PORTS))}) OR (dst_port IN ({', '.join(map(q, V.EXTERNAL_ONLY_PORTS))}) AND NOT starts_with(dst_ip, '10.')))",
            f"CASE WHEN dst_port IN ({', '.join(map(q, V.ATTACKER_PORTS))}) THEN 'High' ELSE 'Medium' END",
            f"CASE WHEN dst_port IN ({', '.join(map(q, V.ATTACKER_PORTS))}) THEN 'Connection to known C2 port ' || dst_port || ' → ' || dst_ip"
            " ELSE 'Connection to suspicious port ' || dst_port || ' on external host ' || dst_ip END",
            "'Host: ' || host",
        ),
        "NET-DATAXFR-001": rows(
            "NET-DATAXFR-001", SUMMED,
            f"bytes >= {V.SINGLE_UPLOAD_BYTES} OR (bytes > 0 AND n >= {V.WINDOW_UPLOAD_BYTES} AND n // {V.WINDOW_UPLOAD_BYTES} > (n - bytes) // {V.WINDOW_UPLOAD_BYTES})",
            f"CASE WHEN bytes >= {V.SINGLE_UPLOAD_BYTES} THEN 'Medium' ELSE 'High' END",
            f"CASE WHEN bytes >= {V.SINGLE_UPLOAD_BYTES} THEN 'Single outbound transfer of ' || CAST(bytes // 1000000 AS VARCHAR) || ' MB from ''' || host || ''' to ' || dst_ip"
            f" ELSE 'Cumulative outbound transfer from ''' || host || ''': ' || CAST(n // 1000000000 AS VARCHAR) || ' GB ' || CAST(n % 1000000000 // 1000000 AS VARCHAR) || ' MB in the window' END",
        ),
        "NET-SMBLAT-001": rows(
            "NET-SMBLAT-001", distinct("host", "dst_ip", f"{NET} AND dst_port = '445'"), nth(V.SMB_TARGETS_EVERY), "'High'",
            f"'Host ''' || host || ''' made SMB connections to ' || {N} || ' distinct targets'",
            "'Lateral movement via SMB — possible remote execution or file share access'",
        ),
        "AUTH-SFBRUTE-001": rows(
            "AUTH-SFBRUTE-001", FAILED, f"n >= {V.FAILURES_BEFORE_SUCCESS}", "'High'",
            f"'Login SUCCESS for ''' || \"user\" || ''' on ''' || host || ''' after ' || {N} || ' failures from ' || source_ip",
            "'Source IP had repeated authentication failures before succeeding'",
        ),
        "AUTH-SPRAY-001": rows(
            "AUTH-SPRAY-001", distinct("source_ip", '"user"', "event_type = 'login_failure'"), nth(V.SPRAY_USERS_EVERY), "'High'",
            f"'Source IP ' || source_ip || ' failed authentication against ' || {N} || ' distinct accounts on ''' || host || ''''",
            "'Low-and-slow password spray pattern — one password tried across many accounts'",
        ),
    }
    return out


def rule_sql(rule_id: str) -> str:
    return with_view(rule_selects()[rule_id], LATERAL_CTE if rule_id == "PS-LATERAL-001" else "")


ALL_DETECTIONS_CTE = LATERAL_CTE + ", det0 AS (" + " UNION ALL ".join(rule_selects().values()) + "), " + (
    "det AS (SELECT det0.*, ev.host, ev.ts FROM det0 JOIN ev USING (seq))"
)
SUMMARY = "count(*) AS total, " + ", ".join(
    f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in reversed(V.SEVERITIES)
)


def oracle_queries() -> dict[str, str]:
    out = {
        "trailing_count": with_view(
            f"SELECT seq, host, n FROM {counted('host, event_type', 'TRUE')}"
        ),
        "point_in_time_count": with_view(
            f"SELECT f.seq, (SELECT count(*) FROM ev c WHERE c.event_type = 'login_failure' AND c.host = f.host AND c.us BETWEEN f.us - {W} AND f.us) AS n"
            " FROM ev f WHERE f.event_type = 'login_failure'"
        ),
        "windowed_distinct": with_view(
            f"SELECT seq, host, n FROM {distinct('host', 'dst_port', NET)}"
        ),
        "windowed_sum_crossing": with_view(
            f"SELECT seq, host, n AS total, n - bytes AS before FROM {SUMMED} WHERE n >= 500000000 AND n // 500000000 > (n - bytes) // 500000000"
        ),
        "cooccurrence": with_view("SELECT seq, p_seq, n_seq FROM lateral_rows", LATERAL_CTE),
        "cooccurrence_default_window": with_view(
            "SELECT seq, p_seq, n_seq FROM lateral_rows", LATERAL_CTE.replace(str(W), str(V.DEFAULT_WINDOW_SECS * 1_000_000))
        ).replace("epoch_us(ts) AS us", f"epoch_us(ts) // {DENSER} AS us"),
        "rules_disabled": with_view(
            f"SELECT rule_id, seq, severity, score, evidence FROM det WHERE rule_id NOT IN ({', '.join(map(q, DISABLED_RULES))})", ALL_DETECTIONS_CTE
        ),
        "report_json": with_view(
            f"SELECT (SELECT count(*) FROM ev) AS events_processed, {LEVEL} AS threat_level, total, critical"
            f" FROM (SELECT CAST(sum(score) AS BIGINT) AS score, {SUMMARY} FROM det)",
            ALL_DETECTIONS_CTE,
        ),
        "detections_sink": with_view("SELECT rule_id, seq, severity, score, evidence FROM det", ALL_DETECTIONS_CTE),
        "custom_rule": with_view(f"SELECT seq, n || ' in window' AS evidence FROM {counted('host', FAILURE)} WHERE n % 10 = 0"),
        "running_score": with_view(
            "SELECT severity, count(*) AS detections, CAST(sum(score) AS BIGINT) AS score FROM det GROUP BY 1", ALL_DETECTIONS_CTE
        ),
        "json_deep": with_view(
            "SELECT seq, 'v' || k AS cmd, CAST(k AS VARCHAR) AS marked, 50 AS script, CASE WHEN k % 12 = 0 THEN 3 ELSE 6 END AS fields,"
            " 2 * (k % 12) + 5 AS longest FROM ev0"
        ),
        "event_identity": (
            "SELECT sha256('json|events|' || row_number() OVER (PARTITION BY props ORDER BY event_id) || '|' || props) AS event_id FROM events"
        ),
        "source_failures": with_view(
            "SELECT k % 4 AS part, 'ok' AS status, count(*) AS lines FROM ev0 GROUP BY 1"
            " UNION ALL SELECT 4, 'incomplete', NULL UNION ALL SELECT 5, 'missing', NULL"
        ),
        "timestamps": with_view("SELECT seq, CASE WHEN k % 7 = 0 THEN epoch_us(TIMESTAMP '2000-01-01') ELSE us END AS us FROM ev0"),
        "private_ip": (
            "SELECT seq, ip, regexp_matches(ip, '^(10\\.|127\\.|169\\.254\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') AS private FROM ("
            "SELECT event_id AS seq, CASE user_id % 8 WHEN 0 THEN '10.' || k || '.1.1' WHEN 1 THEN '172.' || k || '.0.1' WHEN 2 THEN '192.168.' || k || '.9'"
            " WHEN 3 THEN '127.0.0.' || k WHEN 4 THEN '169.254.1.' || k WHEN 5 THEN 'fe80::' || k WHEN 6 THEN '17' || k || '.20.1.1' ELSE k || '.8.8.8' END AS ip"
            " FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))"
        ),
        "rules_bad_isolated": sigma_sql("contains_list"),
        "sigma_compat": " UNION ALL ".join(f"SELECT * FROM ({sigma_sql(name)})" for name in COMPAT_RULES),
        "union_sources": with_view(
            "SELECT t AS event_type, CAST(c * (SELECT count(*) FROM ev0) AS BIGINT) AS events, CAST(c * (SELECT count(*) FROM ev0) AS BIGINT) AS numbers"
            " FROM (VALUES ('login_failure', 9), ('unknown', 8)) x(t, c)"
        ),
        "preceding_failures": with_view(f"SELECT seq, n FROM {FAILED} WHERE n >= 3"),
        "preceded_by_type": with_view(f"SELECT seq, found AS present FROM {PRECEDED}"),
        "host_filter": with_view("SELECT seq, host, event_type FROM ev WHERE lower(host) IN ('h3', 'h7')"),
        "events_by_source": with_view("SELECT 'mock:' || kind AS source, count(*) AS events FROM ev GROUP BY 1"),
        "detections": with_view("SELECT rule_id, seq, severity, score, evidence FROM det", ALL_DETECTIONS_CTE),
        "severity_summary": with_view(f"SELECT {SUMMARY} FROM det", ALL_DETECTIONS_CTE),
        "score_level": with_view(
            f"SELECT score, {LEVEL} AS threat_level FROM (SELECT CAST(sum(score) AS BIGINT) AS score FROM det)", ALL_DETECTIONS_CTE
        ),
        "detections_by_rule": with_view(
            "SELECT rule_id, severity, count(*) AS detections FROM det GROUP BY 1, 2", ALL_DETECTIONS_CTE
        ),
        "host_day_score": with_view(
            f"SELECT host, day, detections, score, {LEVEL} AS threat_level FROM (SELECT host, strftime(ts, '%Y-%m-%d') AS day,"
            " count(*) AS detections, CAST(sum(score) AS BIGINT) AS score FROM det GROUP BY 1, 2)",
            ALL_DETECTIONS_CTE,
        ),
        "report": with_view(
            f"SELECT (SELECT count(*) FROM ev) AS events_processed, score, {LEVEL} AS threat_level, total, critical, high, medium, low, info"
            f" FROM (SELECT CAST(sum(score) AS BIGINT) AS score, {SUMMARY} FROM det)",
            ALL_DETECTIONS_CTE,
        ),
    }
    for rule_id in V.RULE_HEADS:
        out[f"rule_{rule_id}"] = rule_sql(rule_id)
    for name in SIGMA_RULES:
        out[f"sigma_{name}"] = sigma_sql(name)
    out.update(source_sql())
    out.update(stream_sql())
    found = "SELECT rule_id, seq, severity, score, evidence FROM det"
    distinct_rules = "'NET-PORTSCAN-001', 'NET-SMBLAT-001', 'AUTH-SPRAY-001'"
    out["stream_detections"] = out["detections"]
    out["stream_report"] = out["report_counted"] = out["report"]
    out["custom_rule_batches"] = out["custom_rule"]
    out["stream_presence"] = out["rule_REG-PERSIST-001"]
    out["stream_distinct"] = with_view(f"{found} WHERE rule_id IN ({distinct_rules})", ALL_DETECTIONS_CTE)
    out["stream_lateral"] = with_view(
        "SELECT d.seq, 'e' || l.seq || ',e' || l.p_seq || ',e' || l.n_seq AS events, d.evidence"
        " FROM det d JOIN lateral_rows l ON d.seq = l.seq WHERE d.rule_id = 'PS-LATERAL-001'", ALL_DETECTIONS_CTE
    )
    late = "seq % 97 = 0 AND us < (SELECT max(us) FROM ev WHERE seq % 97 <> 0) - 86400000000"
    out["stream_late_rows"] = with_view(f"SELECT seq, event_type, count(*) OVER () AS counted FROM ev WHERE {late}")
    return out
