"""The built-in rules. Word lists, thresholds and rule heads are in ``fixed_values``."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.text import (
    all_matches,
    contains_all,
    contains_any,
    ends_with_any,
    first_match,
    is_private_ip,
    line,
    lines,
    lowered,
    parse_u64,
)
from ..operators.context import crosses_multiple, every_nth
from ..operators.cooccurrence import co_occurrence
from .rules import PROCESS_LIKE, Branch, FrameRule, LevelRule, Rule, StatelessRule, of_type

DESCRIPTIONS = {
    "PS-LATERAL-001": "A service was installed within the window of a PowerShell process and a network connection (T1059.001, T1543.003).",
    "CRED-DUMP-001": "A process command names a credential dumping tool (T1003).",
    "EXEC-LOLBIN-001": "A system binary often used by attackers was run with a remote address, a writable path or a decode switch (T1218).",
    "EXEC-ENCODE-001": "A command carries encoding or obfuscation markers (T1027, T1059.001).",
    "SUSP-WMI-001": "WMI was used to start processes, reach other machines or delete shadow copies (T1047).",
    "SUSP-SCHTASK-001": "A scheduled task was created or changed (T1053).",
    "ACCOUNT-CREATE-001": "A command creates a local or domain account (T1136).",
    "EXEC-SHADOW-001": "Backups or shadow copies were deleted or recovery was switched off (T1490).",
    "EXEC-AVDEF-001": "A security tool was stopped, disabled or told to exclude paths (T1562).",
    "EXEC-LOGCLR-001": "Event logs or audit policies were cleared (T1070.001).",
    "EXEC-RECON-001": "One host ran many discovery commands within the window (T1082, T1016).",
    "EXEC-OFFMAC-001": "An office application started a shell or scripting engine (T1566, T1204.002).",
    "EXEC-DLCRD-001": "A command downloads and runs code, or abuses certutil to fetch or decode a file (T1059.001, T1105).",
    "EXEC-PIPE-001": "A command names a pipe used by attack frameworks or a pipe-creating interface (T1559).",
    "EXEC-PSEXEC-001": "A remote execution tool appears as command, parent or service (T1570, T1021.002).",
    "FILE-DROP-001": "An executable file was written to a staging folder (T1105).",
    "FILE-RANSOM-001": "One host created many files with ransomware suffixes within the window (T1486).",
    "FILE-ARCEXF-001": "An archive tool wrote to a staging folder or remote place (T1560).",
    "REG-PERSIST-001": "A registry key used for persistence was changed (T1547.001).",
    "AUTH-BRUTE-001": "Many failed logins against one host within the window (T1110).",
    "DNS-TUNNEL-001": "Many DNS queries from one host within the window, or a very long query name (T1071.004).",
    "NET-BEACON-001": "One host keeps connecting to one address within the window (T1071).",
    "NET-PORTSCAN-001": "One host reached many distinct ports within the window (T1046).",
    "NET-C2PORT-001": "A connection uses a port known from attack tools, or a proxy or clear-text port on an external address (T1571).",
    "NET-DATAXFR-001": "A large amount of data left one host, at once or within the window (T1048).",
    "NET-SMBLAT-001": "One host reached several SMB targets within the window (T1021.002).",
    "AUTH-SFBRUTE-001": "A login succeeded after several failures from the same address on the same host (T1110).",
    "AUTH-SPRAY-001": "One address failed to log in to many accounts within the window (T1110.003).",
}


def _head(rule_id: str) -> dict:
    name, tags = V.RULE_HEADS[rule_id]
    return {"rule_id": rule_id, "name": name, "description": DESCRIPTIONS[rule_id], "tags": tuple(tags)}


def _or(column: str, default: str) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def _texts() -> SimpleNamespace:
    """Texts that many rules share. ``_cmd`` is the lower-cased command, computed once per event."""
    cmd = F.col("_cmd")
    host, user = _or("host", "unknown"), _or("user", "unknown")
    return SimpleNamespace(
        cmd=cmd,
        command_line=line("Command: ", cmd),
        host=host,
        user=user,
        host_user=line("Host: ", host, "  |  User: ", user),
        host_user_pid=line("Host: ", host, "  |  User: ", user, "  |  PID: ", _or("pid", "?")),
    )


def _command_rule(rule_id: str, severity: str, *branches: tuple[Column, Column], types=PROCESS_LIKE) -> StatelessRule:
    return StatelessRule(
        **_head(rule_id), types=types, branches=tuple(Branch(when, severity, evidence) for when, evidence in branches)
    )


def command_rules() -> list[Rule]:
    t = _texts()
    quoted = lambda words: line("'", first_match(t.cmd, words), "'")
    office_parent = lowered(F.col("parent_image"))
    office_call = F.concat(lowered(F.col("exe")), F.lit(" "), t.cmd)
    tool_text = F.concat(t.cmd, F.lit(" "), lowered(F.col("parent_image")))
    service = lowered(F.coalesce(F.col("service_name"), F.col("name")))
    is_service = of_type("service_installation")
    return [
        _command_rule(
            "CRED-DUMP-001", "Critical",
            (
                contains_any(t.cmd, V.CREDENTIAL_DUMP_WORDS) | contains_all(t.cmd, V.CREDENTIAL_DUMP_PAIR),
                lines(
                    line(
                        "Credential dumping indicator: '",
                        F.coalesce(first_match(t.cmd, V.CREDENTIAL_DUMP_WORDS), F.lit(" ".join(V.CREDENTIAL_DUMP_PAIR))),
                        "'",
                    ),
                    t.command_line,
                    t.host_user,
                ),
            ),
            types=("process_creation",),
        ),
        _command_rule(
            "EXEC-LOLBIN-001", "High",
            (
                contains_any(t.cmd, V.LOLBIN_TOOLS) & contains_any(t.cmd, V.LOLBIN_PATTERNS),
                lines(
                    line("LOLBin ", quoted(V.LOLBIN_TOOLS), " invoked with suspicious pattern ", quoted(V.LOLBIN_PATTERNS)),
                    t.command_line,
                    t.host_user_pid,
                ),
            ),
        ),
        _command_rule(
            "EXEC-ENCODE-001", "High",
            (
                contains_any(t.cmd, V.ENCODED_MARKERS),
                lines(
                    line("Obfuscation patterns matched: ", all_matches(t.cmd, V.ENCODED_MARKERS)),
                    t.command_line,
                    t.host_user_pid,
                ),
            ),
        ),
        _command_rule(
            "SUSP-WMI-001", "High",
            (
                contains_any(t.cmd, V.WMI_TOOLS) & contains_any(t.cmd, V.WMI_SUBCOMMANDS),
                lines(line("WMI execution sub-command detected: ", quoted(V.WMI_SUBCOMMANDS)), t.command_line, t.host_user),
            ),
        ),
        _command_rule(
            "SUSP-SCHTASK-001", "Medium",
            (
                contains_any(t.cmd, V.TASK_TOOLS) & contains_any(t.cmd, V.TASK_SUBCOMMANDS),
                lines(line("Scheduled task created/modified: ", t.cmd), t.host_user),
            ),
        ),
        _command_rule(
            "ACCOUNT-CREATE-001", "High",
            (
                contains_any(t.cmd, V.ACCOUNT_PATTERNS) | contains_all(t.cmd, V.ACCOUNT_PAIR),
                lines(
                    line("Account creation command detected: ", t.cmd),
                    line("Host: ", t.host, "  |  Executed by: ", t.user),
                ),
            ),
        ),
        _command_rule(
            "EXEC-SHADOW-001", "Critical",
            (
                contains_any(t.cmd, V.SHADOW_INDICATORS) | contains_all(t.cmd, V.SHADOW_PAIR),
                lines(
                    line(
                        "Backup-inhibit indicator: '",
                        F.coalesce(first_match(t.cmd, V.SHADOW_INDICATORS), F.lit(V.SHADOW_PAIR_LABEL)),
                        "'",
                    ),
                    t.command_line,
                    t.host_user,
                ),
            ),
        ),
        _command_rule(
            "EXEC-AVDEF-001", "High",
            (
                contains_any(t.cmd, V.AV_DISABLE_PATTERNS),
                lines(line("AV/EDR disabling cmdlet detected: ", quoted(V.AV_DISABLE_PATTERNS)), t.command_line, t.host_user),
            ),
            (
                contains_any(t.cmd, V.SERVICE_ACTIONS) & contains_any(t.cmd, V.AV_SERVICES),
                lines(line("Security service ", quoted(V.AV_SERVICES), " stopped or disabled"), t.command_line, t.host_user),
            ),
        ),
        _command_rule(
            "EXEC-LOGCLR-001", "High",
            (
                contains_any(t.cmd, V.LOG_CLEAR_PATTERNS),
                lines(line("Log-clearing pattern matched: ", quoted(V.LOG_CLEAR_PATTERNS)), t.command_line, t.host_user),
            ),
        ),
        _command_rule(
            "EXEC-OFFMAC-001", "Critical",
            (
                contains_any(office_parent, V.OFFICE_APPS) & contains_any(office_call, V.OFFICE_CHILDREN),
                lines(
                    line("Office parent: ", office_parent),
                    line("Suspicious child: '", first_match(office_call, V.OFFICE_CHILDREN), "'  →  ", t.cmd),
                    t.host_user,
                ),
            ),
            types=("process_creation",),
        ),
        _command_rule(
            "EXEC-DLCRD-001", "High",
            (
                t.cmd.contains(V.CERTUTIL_NAME) & contains_any(t.cmd, V.CERTUTIL_FLAGS),
                lines(line("certutil used to download or decode a remote file"), t.command_line, t.host_user),
            ),
            (
                contains_any(t.cmd, V.DOWNLOAD_PATTERNS) & contains_any(t.cmd, V.CRADLE_EXEC_PATTERNS),
                lines(
                    line("Download-and-execute cradle detected (download function + IEX/assembly load)"),
                    t.command_line,
                    t.host_user,
                ),
            ),
        ),
        _command_rule(
            "EXEC-PIPE-001", "Critical",
            (
                contains_any(t.cmd, V.PIPE_INDICATORS),
                lines(line("Named pipe indicator matched: ", quoted(V.PIPE_INDICATORS)), t.command_line, t.host_user_pid),
            ),
        ),
        _command_rule(
            "EXEC-PSEXEC-001", "High",
            (
                is_service & contains_any(service, V.REMOTE_EXEC_SERVICES),
                lines(
                    line("PsExec service installed: '", first_match(service, V.REMOTE_EXEC_SERVICES), "'"),
                    line("Host: ", t.host),
                ),
            ),
            (
                ~is_service & contains_any(tool_text, V.REMOTE_EXEC_TOOLS),
                lines(
                    line("Remote execution tool indicator: '", first_match(tool_text, V.REMOTE_EXEC_TOOLS), "'"),
                    t.command_line,
                    t.host_user,
                ),
            ),
            types=("service_installation", *PROCESS_LIKE),
        ),
        _command_rule(
            "FILE-ARCEXF-001", "High",
            (
                contains_any(t.cmd, V.ARCHIVE_TOOLS) & contains_any(t.cmd, V.ARCHIVE_DESTINATIONS),
                lines(
                    line("Archive tool used with suspicious destination ", quoted(V.ARCHIVE_DESTINATIONS)),
                    t.command_line,
                    t.host_user,
                ),
            ),
        ),
    ]


def file_and_network_rules() -> list[Rule]:
    t = _texts()
    path = lowered(F.coalesce(F.col("file_path"), F.col("path"), F.col("target")))
    port, ip = _or("dst_port", ""), _or("dst_ip", "")
    sent = parse_u64(F.col("bytes_out"))
    return [
        StatelessRule(
            **_head("FILE-DROP-001"),
            types=("file_creation",),
            branches=(
                Branch(
                    contains_any(path, V.STAGING_DIRS) & ends_with_any(path, V.EXECUTABLE_SUFFIXES),
                    "High",
                    lines(line("Executable file created: ", path), t.host_user),
                ),
            ),
        ),
        StatelessRule(
            **_head("NET-C2PORT-001"),
            types=("network_connection",),
            branches=(
                Branch(
                    port.isin(*V.ATTACKER_PORTS),
                    "High",
                    lines(line("Connection to known C2 port ", port, " → ", ip), line("Host: ", t.host)),
                ),
                Branch(
                    port.isin(*V.EXTERNAL_ONLY_PORTS) & (ip != "") & ~is_private_ip(ip),
                    "Medium",
                    lines(
                        line("Connection to suspicious port ", port, " on external host ", ip),
                        line("Host: ", t.host),
                    ),
                ),
            ),
        ),
        StatelessRule(
            **_head("NET-DATAXFR-001"),
            types=("network_connection",),
            branches=(
                Branch(
                    sent >= V.SINGLE_UPLOAD_BYTES,
                    "Medium",
                    lines(
                        line(
                            "Single outbound transfer of ",
                            F.call_function("div", sent, F.lit(1_000_000)).cast("string"),
                            " MB from '", t.host, "' to ", _or("dst_ip", "unknown"),
                        )
                    ),
                ),
            ),
        ),
    ]


def level_rules() -> list[Rule]:
    t = _texts()
    host, user = F.col("host"), t.user
    is_net = of_type("network_connection")
    is_failure = of_type("login_failure")
    discovery = of_type(*PROCESS_LIKE) & contains_any(lowered(F.col("cmd")), V.DISCOVERY_COMMANDS)
    ransom_path = lowered(F.coalesce(F.col("file_path"), F.col("path"), F.col("target"), F.col("filename")))
    ransom = of_type("file_creation") & ends_with_any(ransom_path, V.RANSOM_SUFFIXES)
    is_dns = of_type("dns_query")
    query = F.coalesce(F.col("query"), F.col("name"), F.lit(""))
    query_bytes = F.octet_length(query)
    source = F.col("source_ip")
    has_source = F.coalesce(source, F.lit("")) != ""
    sent = parse_u64(F.col("bytes_out"))
    reg_key = lowered(F.coalesce(F.col("registry_key"), F.col("key")))
    smb = is_net & (F.col("dst_port") == V.SMB_PORT)
    text = lambda level: level.cast("string")

    def prior(level, c):
        return level - c["bytes"].cast("decimal(20,0)")

    def upload(level):
        rest = F.call_function("div", level % 1_000_000_000, F.lit(1_000_000))
        return line(text(F.call_function("div", level, F.lit(1_000_000_000))), " GB ", text(rest), " MB")

    return [
        LevelRule(
            **_head("EXEC-RECON-001"),
            types=PROCESS_LIKE,
            keys=(host,),
            member=discovery,
            trigger=discovery,
            severity="Medium",
            carry={"host": host, "cmd": lowered(F.col("cmd")), "user": user},
            fires=lambda n, c: every_nth(n, V.DISCOVERY_EVERY),
            evidence=lambda n, c: lines(
                line(text(n), " discovery commands executed from host '", c["host"], "'"),
                line("Latest: ", c["cmd"]),
                line("User: ", c["user"]),
            ),
        ),
        LevelRule(
            **_head("FILE-RANSOM-001"),
            types=("file_creation",),
            keys=(host,),
            member=ransom,
            trigger=ransom,
            severity="Critical",
            carry={"host": host, "path": ransom_path, "user": user},
            fires=lambda n, c: every_nth(n, V.RANSOM_EVERY),
            evidence=lambda n, c: lines(
                line(text(n), " files with ransomware extensions created on '", c["host"], "'"),
                line("Latest encrypted file: ", c["path"]),
                line("User: ", c["user"]),
            ),
        ),
        LevelRule(
            **_head("AUTH-BRUTE-001"),
            types=("login_failure",),
            keys=(host,),
            member=is_failure,
            trigger=is_failure,
            severity="High",
            carry={"host": host, "source": _or("source_ip", "unknown")},
            fires=lambda n, c: every_nth(n, V.BRUTE_FORCE_EVERY),
            evidence=lambda n, c: lines(
                line(text(n), " failed login attempts against host '", c["host"], "' from ", c["source"])
            ),
        ),
        LevelRule(
            **_head("DNS-TUNNEL-001"),
            types=("dns_query",),
            keys=(host,),
            null_key=True,
            member=is_dns,
            trigger=is_dns,
            severity="High",
            carry={
                "host": t.host,
                "bytes": query_bytes.cast("string"),
                "query": F.substring(query, 1, V.DNS_QUOTED_CHARS),
                "resolver": F.coalesce(F.col("dst_ip"), F.col("resolver"), F.lit("unknown")),
            },
            fires=lambda n, c: (c["bytes"].cast("int") > V.DNS_LONG_BYTES) | every_nth(n, V.DNS_EVERY),
            evidence=lambda n, c: lines(
                F.when(
                    n >= V.DNS_EVERY,
                    line(text(n), " DNS queries from host '", c["host"], "' within the correlation window"),
                ),
                F.when(
                    c["bytes"].cast("int") > V.DNS_LONG_BYTES,
                    line("Long DNS query name (", c["bytes"], " chars): ", c["query"]),
                ),
                line("Resolver: ", c["resolver"]),
            ),
        ),
        LevelRule(
            **_head("NET-BEACON-001"),
            types=("network_connection",),
            keys=(host, F.col("dst_ip")),
            member=is_net,
            trigger=is_net & (F.col("dst_ip") != ""),
            severity="Medium",
            carry={"host": host, "ip": F.col("dst_ip"), "port": _or("dst_port", "?")},
            fires=lambda n, c: every_nth(n, V.BEACON_EVERY),
            evidence=lambda n, c: lines(
                line(text(n), " connections from '", c["host"], "' to ", c["ip"], ":", c["port"], " in the correlation window"),
                line("Regular repeated connections suggest automated C2 beaconing"),
            ),
        ),
        LevelRule(
            **_head("NET-PORTSCAN-001"),
            types=("network_connection",),
            measure="distinct",
            keys=(host,),
            member=is_net,
            trigger=is_net,
            value=F.col("dst_port"),
            severity="Medium",
            carry={"host": host},
            fires=lambda n, c: every_nth(n, V.PORT_SCAN_EVERY),
            evidence=lambda n, c: lines(
                line("Host '", c["host"], "' probed ", text(n), " distinct destination ports in the correlation window")
            ),
        ),
        LevelRule(
            **_head("NET-DATAXFR-001"),
            types=("network_connection",),
            measure="sum",
            keys=(host,),
            member=is_net & sent.isNotNull(),
            trigger=is_net & (sent > 0) & (sent < V.SINGLE_UPLOAD_BYTES),
            value=sent,
            severity="High",
            carry={"host": host, "bytes": sent.cast("string")},
            fires=lambda n, c: crosses_multiple(n, prior(n, c), V.WINDOW_UPLOAD_BYTES),
            evidence=lambda n, c: lines(
                line("Cumulative outbound transfer from '", c["host"], "': ", upload(n), " in the window")
            ),
        ),
        LevelRule(
            **_head("NET-SMBLAT-001"),
            types=("network_connection",),
            measure="distinct",
            keys=(host,),
            member=smb,
            trigger=smb,
            value=F.col("dst_ip"),
            severity="High",
            carry={"host": host},
            fires=lambda n, c: every_nth(n, V.SMB_TARGETS_EVERY),
            evidence=lambda n, c: lines(
                line("Host '", c["host"], "' made SMB connections to ", text(n), " distinct targets"),
                line("Lateral movement via SMB — possible remote execution or file share access"),
            ),
        ),
        LevelRule(
            **_head("AUTH-SFBRUTE-001"),
            types=("login_failure", "login_success"),
            keys=(host, source),
            member=is_failure,
            trigger=of_type("login_success") & has_source,
            severity="High",
            carry={"host": host, "source": source, "user": user},
            fires=lambda n, c: n >= V.FAILURES_BEFORE_SUCCESS,
            evidence=lambda n, c: lines(
                line("Login SUCCESS for '", c["user"], "' on '", c["host"], "' after ", text(n), " failures from ", c["source"]),
                line("Source IP had repeated authentication failures before succeeding"),
            ),
        ),
        LevelRule(
            **_head("AUTH-SPRAY-001"),
            types=("login_failure",),
            measure="distinct",
            keys=(source,),
            member=is_failure,
            trigger=is_failure & has_source,
            value=F.col("user"),
            severity="High",
            carry={"host": t.host, "source": source},
            fires=lambda n, c: every_nth(n, V.SPRAY_USERS_EVERY),
            evidence=lambda n, c: lines(
                line("Source IP ", c["source"], " failed authentication against ", text(n), " distinct accounts on '", c["host"], "'"),
                line("Low-and-slow password spray pattern — one password tried across many accounts"),
            ),
        ),
        LevelRule(
            **_head("REG-PERSIST-001"),
            types=("registry_modification", "process_creation"),
            measure="present",
            member=of_type("process_creation"),
            trigger=of_type("registry_modification") & contains_any(reg_key, V.PERSISTENCE_KEYS),
            severity="Medium",
            carry={
                "key": reg_key,
                "value": F.coalesce(F.col("registry_value"), F.col("value"), F.lit("unknown")),
                "host": t.host,
                "user": user,
            },
            fires=lambda n, c: F.lit(True),
            evidence=lambda n, c: lines(
                line("Registry key modified: ", c["key"]),
                line("Value written: ", c["value"]),
                line("Host: ", c["host"], "  |  User: ", c["user"]),
                F.when(n > 0, F.lit("Preceded by a ProcessCreation event in the same correlation window")),
            ),
        ),
    ]


LATERAL_TYPES = ("process_creation", "network_connection", "service_installation")


def _find_lateral(events: DataFrame, window_secs: float, by: tuple[str, ...] = ()) -> DataFrame:
    is_shell = of_type("process_creation") & contains_any(lowered(F.col("cmd")), V.POWERSHELL_NAMES)
    part = (
        F.when(is_shell, "shell")
        .when(of_type("network_connection"), "net")
        .when(of_type("service_installation"), "service")
    )
    fields = ["event_id", "host", "service_name", "cmd", "dst_ip", "dst_port"]
    narrow = events.where(of_type(*LATERAL_TYPES)).select("seq", "us", *fields, part.alias("part"))

    def is_(name):
        return F.col("part") == name

    found = co_occurrence(
        narrow, window_secs, trigger=is_("service"), first=is_("shell"), second=is_("net"), by=by, keep=fields
    )
    shell, net = F.col("first_event"), F.col("second_event")
    return found.select(
        "seq", "us", "host",
        F.lit("Critical").alias("severity"),
        F.array("event_id", shell["event_id"], net["event_id"]).alias("event_ids"),
        lines(
            line("PowerShell spawned: ", shell["cmd"]),
            line(
                "Outbound connection to ",
                F.coalesce(net["dst_ip"], F.lit("unknown")), ":", F.coalesce(net["dst_port"], F.lit("?")),
            ),
            line("Service installed: ", _or("service_name", "unknown")),
        ).alias("evidence"),
    )


def lateral_rule() -> Rule:
    return FrameRule(**_head("PS-LATERAL-001"), types=LATERAL_TYPES, find=_find_lateral)


def builtin_rules() -> list[Rule]:
    return [lateral_rule(), *command_rules(), *file_and_network_rules(), *level_rules()]
