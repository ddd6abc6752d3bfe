"""Fixed values.

Everything in this module is a constant that results depend on: thresholds, word lists,
lookup tables, rule heads. They are stated as plain text in list order, because evidence
quotes the first entry of a list that matches.
"""

# --- severities and threat bands -------------------------------------------------------

SEVERITIES = ["Info", "Low", "Medium", "High", "Critical"]
SEVERITY_WEIGHT = {"Info": 1, "Low": 5, "Medium": 15, "High": 30, "Critical": 50}
THREAT_BANDS = [(85, "CRITICAL_INCIDENT"), (60, "LIKELY_COMPROMISE"), (30, "SUSPICIOUS"), (0, "CLEAN")]

DEFAULT_WINDOW_SECS = 120

# --- event types -----------------------------------------------------------------------

EVENT_TYPES = [
    "process_creation",
    "network_connection",
    "file_creation",
    "service_installation",
    "registry_modification",
    "login_attempt",
    "login_success",
    "login_failure",
    "privilege_escalation",
    "command_execution",
    "dns_query",
]

EVENT_ID_TYPES = {
    1: "process_creation",
    4688: "process_creation",
    3: "network_connection",
    5156: "network_connection",
    11: "file_creation",
    7045: "service_installation",
    4657: "registry_modification",
    13: "registry_modification",
    4648: "login_attempt",
    4624: "login_success",
    4625: "login_failure",
    4771: "login_failure",
    4672: "privilege_escalation",
    4103: "command_execution",
    4104: "command_execution",
    800: "command_execution",
    22: "dns_query",
}

NUMERIC_LEVELS = {1: "Critical", 2: "High", 3: "Medium", 4: "Low", 5: "Low"}

TIMESTAMP_KEYS = ["timestamp", "@timestamp", "TimeCreated", "time", "event_time", "datetime"]

# --- field names -----------------------------------------------------------------------

# canonical key -> aliases, in order of preference
FIELD_ALIASES = {
    "cmd": ["command_line", "CommandLine", "ProcessCommandLine"],
    "exe": ["Image"],
    "parent_image": ["ParentImage", "ParentProcessName"],
    "host": ["hostname", "Hostname", "computer", "Computer", "ComputerName", "WorkstationName"],
    "user": [
        "username", "Username", "UserName", "User",
        "SubjectUserName", "TargetUserName", "AccountName",
    ],
    "source_ip": ["src_ip", "SourceIp", "SourceAddress"],
    "src_port": ["SourcePort"],
    "dst_ip": ["dest_ip", "DestinationIp", "DestinationAddress"],
    "dst_port": ["dest_port", "DestinationPort"],
    "bytes_out": ["bytes_sent", "BytesSent", "BytesOut"],
    "file_path": ["file_name", "FileName", "TargetFilename", "FilePath"],
    "registry_key": ["TargetObject", "RegistryKey"],
    "registry_value": ["Details"],
    "query": ["QueryName", "dns_name"],
    "service_name": ["ServiceName"],
    "image_path": ["ImagePath"],
}

# Opt-in names: what lower-casing leaves of common Windows field names.
EXTENDED_ALIASES = {
    "dst_ip": ["destinationip"],
    "dst_port": ["destinationport"],
    "file_path": ["targetfilename"],
    "exe": ["image"],
}

# Windows record field -> canonical key; any other field is lower-cased
WINDOWS_FIELDS = {
    "CommandLine": "cmd",
    "Image": "image",
    "ParentImage": "parent_image",
    "User": "user",
    "SubjectUserName": "user",
    "TargetUserName": "target_user",
    "IpAddress": "source_ip",
    "SourceAddress": "source_ip",
    "ProcessId": "pid",
    "NewProcessId": "pid",
    "ProcessID": "pid",
    "ServiceName": "service_name",
    "ImagePath": "image_path",
    "TargetObject": "registry_key",
    "Details": "registry_value",
    "DestAddress": "dst_ip",
    "DestPort": "dst_port",
    "SourcePort": "src_port",
    "QueryName": "query",
}

# --- Sigma -----------------------------------------------------------------------------

SIGMA_LEVELS = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low"}

SIGMA_LOGSOURCES = {
    "process_creation": "process_creation",
    "process_creation_windows": "process_creation",
    "network_connection": "network_connection",
    "network_traffic": "network_connection",
    "dns": "dns_query",
    "dns_query": "dns_query",
    "file_event": "file_creation",
    "file_creation": "file_creation",
    "registry_event": "registry_modification",
    "registry_add": "registry_modification",
    "registry_set": "registry_modification",
    "registry_delete": "registry_modification",
    "logon_failed": "login_failure",
    "login_failure": "login_failure",
    "logon": "login_success",
    "login_success": "login_success",
}

# --- thresholds ------------------------------------------------------------------------

BRUTE_FORCE_EVERY = 5
DISCOVERY_EVERY = 5
RANSOM_EVERY = 10
DNS_EVERY = 10
DNS_LONG_BYTES = 40
DNS_QUOTED_CHARS = 80
BEACON_EVERY = 8
PORT_SCAN_EVERY = 15
SMB_TARGETS_EVERY = 3
SPRAY_USERS_EVERY = 5
FAILURES_BEFORE_SUCCESS = 3
SINGLE_UPLOAD_BYTES = 50_000_000
WINDOW_UPLOAD_BYTES = 500_000_000

# --- word lists ------------------------------------------------------------------------

POWERSHELL_NAMES = ["powershell", "pwsh"]

# README-only indicators (the rest of that list is not public)
CREDENTIAL_DUMP_WORDS = ["mimikatz", "sekurlsa", "lsadump"]
CREDENTIAL_DUMP_PAIR = ["procdump", "lsass"]

LOLBIN_TOOLS = [
    "certutil.exe", "mshta.exe", "wscript.exe", "cscript.exe", "regsvr32.exe", "rundll32.exe",
    "msiexec.exe", "bitsadmin.exe", "msbuild.exe", "installutil.exe", "regasm.exe", "regsvcs.exe",
    "odbcconf.exe", "mavinject.exe", "ieexec.exe", "forfiles.exe", "pcalua.exe",
]
LOLBIN_PATTERNS = [
    "http://", "https://", "ftp://", "\\temp\\", "\\tmp\\", "\\appdata\\", "\\public\\",
    "\\programdata\\", "-urlcache", "-decode", "-decodefile", "javascript:", "vbscript:",
    "scrobj.dll", "/i http",
]

ENCODED_MARKERS = [
    "-encodedcommand", "frombase64string(", "[system.convert]::frombase64",
    "[convert]::frombase64", "`i`e`x", "i`ex", "&([char]", "[scriptblock]::create", "::getstring(",
]

WMI_TOOLS = ["wmic", "invoke-wmimethod", "get-wmiobject", "invoke-cimmethod", "new-cimsession", "wbemtest"]
WMI_SUBCOMMANDS = [
    "process call create", "shadowcopy delete", "/node:", "win32_process",
    "invoke-wmimethod", "invoke-cimmethod",
]

TASK_TOOLS = ["schtasks", "new-scheduledtask", "register-scheduledtask", "at.exe", "taskschd"]
TASK_SUBCOMMANDS = ["/create", "/change", "-action", "-trigger", "-repetitioninterval"]

ACCOUNT_PATTERNS = ["new-localuser", "new-aduser", "dsadd user", "useradd", "adduser"]
ACCOUNT_PAIR = ["net user", "/add"]

SHADOW_INDICATORS = [
    "delete shadows", "delete shadow ", "shadowcopy delete", "vssadmin delete",
    "wbadmin delete catalog", "resize shadowstorage",
]
SHADOW_PAIR = ["bcdedit", "recoveryenabled"]
SHADOW_PAIR_LABEL = "bcdedit recoveryenabled no"

AV_SERVICES = [
    "windefend", "wscsvc", "wdnissvc", "sense", "mssense", "avast", "avg", "mfefire", "mcshield",
    "sophos", "carbonblack", "cbdefense", "cylance", "crowdstrike", "sentinelone", "epp", "sysmon",
]
AV_DISABLE_PATTERNS = [
    "set-mppreference", "disablerealtimemonitoring", "disablebehaviormonitoring", "disableonaccess",
    "disableioavprotection", "add-mppreference -exclusionpath",
    "add-mppreference -exclusionextension", "disableantispyware",
]
SERVICE_ACTIONS = ["net stop", "sc stop", "sc config", "sc delete", "taskkill"]

LOG_CLEAR_PATTERNS = [
    "wevtutil cl", "wevtutil.exe cl", "wevtutil clg", "clear-eventlog", "remove-eventlog",
    "auditpol /clear", "auditpol.exe /clear", "fsutil usn deletejournal", "wevtutil sl",
    "clearall-eventlog", "limit-eventlog",
]

DISCOVERY_COMMANDS = [
    "whoami", "ipconfig", "ifconfig", "arp ", "route print", "netstat", "systeminfo", "nltest",
    "net user", "net group", "net localgroup", "net view", "net session", "net accounts",
    "tasklist", "qwinsta", "quser", "query user", "query session", "nslookup", "dsquery", "dsget",
    "get-aduser", "get-adgroup", "get-adcomputer", "get-netdomaintrust", "get-netforest",
    "invoke-sharefinder", "wmic os get", "wmic useraccount", "wmic computersystem",
]

OFFICE_APPS = [
    "winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "mspub.exe", "msaccess.exe",
    "onenote.exe", "visio.exe", "wordpad.exe",
]
OFFICE_CHILDREN = [
    "powershell", "pwsh", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "regsvr32.exe",
    "rundll32.exe", "msiexec.exe", "wmic.exe", "certutil.exe", "bitsadmin.exe",
]

CERTUTIL_NAME = "certutil"
CERTUTIL_FLAGS = ["-urlcache", "-decode", "-decodefile"]
DOWNLOAD_PATTERNS = [
    "downloadstring", "downloadfile", "downloaddata", "net.webclient", "system.net.webclient",
    "invoke-webrequest", "start-bitstransfer", "bits.start",
]
CRADLE_EXEC_PATTERNS = [
    "| iex", ";iex", "; iex", "(iex", "invoke-expression",
    "[system.reflection.assembly]::load", "[reflection.assembly]::load", "assembly::loadfrom", "|iex",
]

PIPE_INDICATORS = [
    r"pipe\msse-", r"pipe\status_", r"pipe\msagent_", r"pipe\postex_", r"pipe\min_",
    r"pipe\netlogon_", r"pipe\spoolss", r"pipe\lsarpc_",
    "system.io.pipes", "namedpipeserverstream", "namedpipeclientstream", "createnamedpipe",
    "\\\\.\\pipe\\",
]

REMOTE_EXEC_TOOLS = ["psexec", "psexec64", "paexec", "remcom", "csexec"]
REMOTE_EXEC_SERVICES = ["psexesvc", "paexecsvc", "remcomsvc"]

STAGING_DIRS = [
    "\\temp\\", "\\tmp\\", "\\appdata\\roaming\\", "\\appdata\\local\\", "\\users\\public\\",
    "\\programdata\\", "\\windows\\temp\\", "\\recycler\\", "\\$recycle.bin\\",
    "/tmp/", "/dev/shm/", "/var/tmp/",
]
EXECUTABLE_SUFFIXES = [
    ".exe", ".dll", ".ps1", ".bat", ".cmd", ".vbs", ".js", ".hta", ".jar", ".msi",
    ".scr", ".com", ".pif", ".wsf",
]

RANSOM_SUFFIXES = [
    ".locked", ".encrypted", ".enc", ".crypto", ".crypt", ".crypted", ".ransom", ".wncry", ".wcry",
    ".locky", ".thor", ".zepto", ".odin", ".osiris", ".zzz", ".wallet", ".cerber", ".cryp1",
    ".globe", ".dark", ".rip", ".fun", ".pay", ".kill", ".rapid", ".sodinokibi", ".revil", ".ryuk",
    ".phobos", ".dharma", ".matrix", ".makop", ".conti", ".lockbit", ".hive", ".alphv", ".babuk",
    ".avos", ".yanluowang",
]

ARCHIVE_TOOLS = [
    "7z.exe", "7za.exe", "7zr.exe", "rar.exe", "winrar.exe", "zip.exe", "tar.exe",
    "compress-archive", "gzip",
]
ARCHIVE_DESTINATIONS = [
    "\\\\", "\\temp\\", "\\tmp\\", "\\appdata\\", "\\users\\public\\", "\\programdata\\",
    "/tmp/", "/dev/shm/", "ftp://", "http://", "https://",
]

PERSISTENCE_KEYS = [
    r"software\microsoft\windows\currentversion\run",
    r"software\microsoft\windows\currentversion\runonce",
    r"software\microsoft\windows nt\currentversion\winlogon",
    r"system\currentcontrolset\services",
    r"software\microsoft\windows\currentversion\explorer\shell folders",
    r"software\microsoft\windows\currentversion\policies\explorer\run",
]

ATTACKER_PORTS = [
    "4444", "4445", "4443", "31337", "1337", "8888", "9001", "9050",
    "6666", "6667", "6668", "6669", "12345", "27374",
]
EXTERNAL_ONLY_PORTS = ["23", "1080", "3128", "8080", "8443"]
PRIVATE_PREFIXES = ["10.", "127.", "169.254.", "192.168."]

SMB_PORT = "445"

# --- rule heads: id -> (name, tags) ----------------------------------------------------

RULE_HEADS = {
    "PS-LATERAL-001": ("PowerShell Lateral Movement", ["lateral-movement", "powershell", "T1059.001", "T1543.003"]),
    "CRED-DUMP-001": ("Credential Dumping", ["credential-access", "T1003"]),
    "EXEC-LOLBIN-001": ("Living-off-the-Land Binary Abuse", ["lolbin", "defense-evasion", "execution", "T1218"]),
    "EXEC-ENCODE-001": ("Encoded / Obfuscated Command Execution", ["obfuscation", "defense-evasion", "T1027", "T1059.001"]),
    "SUSP-WMI-001": ("WMI Abuse for Execution or Lateral Movement", ["wmi", "execution", "lateral-movement", "T1047"]),
    "SUSP-SCHTASK-001": ("Suspicious Scheduled Task Creation", ["persistence", "scheduled-task", "T1053"]),
    "ACCOUNT-CREATE-001": ("Local or Domain Account Creation", ["persistence", "account-creation", "T1136"]),
    "EXEC-SHADOW-001": ("Shadow Copy / Backup Deletion", ["ransomware", "defense-evasion", "inhibit-recovery", "T1490"]),
    "EXEC-AVDEF-001": ("Security Tool Tampering", ["defense-evasion", "impair-defenses", "T1562"]),
    "EXEC-LOGCLR-001": ("Event Log Clearing", ["defense-evasion", "indicator-removal", "T1070.001"]),
    "EXEC-RECON-001": ("System / Network Discovery Burst", ["discovery", "reconnaissance", "T1082", "T1016"]),
    "EXEC-OFFMAC-001": ("Office Application Spawning Suspicious Child Process", ["initial-access", "macro", "phishing", "T1566", "T1204.002"]),
    "EXEC-DLCRD-001": ("PowerShell / Certutil Download Cradle", ["execution", "download", "cradle", "T1059.001", "T1105"]),
    "EXEC-PIPE-001": ("Suspicious Named Pipe Usage", ["c2", "inter-process-communication", "cobalt-strike", "T1559"]),
    "EXEC-PSEXEC-001": ("PsExec / Remote Execution Tool", ["lateral-movement", "psexec", "remote-execution", "T1570", "T1021.002"]),
    "FILE-DROP-001": ("Executable Dropped in Suspicious Location", ["dropper", "ingress-tool-transfer", "T1105"]),
    "FILE-RANSOM-001": ("Ransomware File Encryption Activity", ["ransomware", "impact", "data-encrypted", "T1486"]),
    "FILE-ARCEXF-001": ("Data Archiving for Exfiltration", ["collection", "archive", "exfiltration", "T1560"]),
    "REG-PERSIST-001": ("Registry Persistence", ["persistence", "registry", "T1547.001"]),
    "AUTH-BRUTE-001": ("Brute Force Authentication Attack", ["brute-force", "authentication", "T1110"]),
    "DNS-TUNNEL-001": ("DNS Tunneling / Exfiltration", ["dns-tunneling", "exfiltration", "c2", "T1071.004"]),
    "NET-BEACON-001": ("C2 Beaconing Pattern", ["c2", "beaconing", "command-and-control", "T1071"]),
    "NET-PORTSCAN-001": ("Port Scan Detected", ["port-scan", "discovery", "T1046"]),
    "NET-C2PORT-001": ("Connection on Known Attacker / C2 Port", ["c2", "command-and-control", "suspicious-port", "T1571"]),
    "NET-DATAXFR-001": ("Large Outbound Data Transfer", ["exfiltration", "large-transfer", "T1048"]),
    "NET-SMBLAT-001": ("SMB Lateral Movement", ["lateral-movement", "smb", "T1021.002"]),
    "AUTH-SFBRUTE-001": ("Successful Login After Multiple Failures", ["brute-force", "credential-access", "T1110"]),
    "AUTH-SPRAY-001": ("Password Spraying Attack", ["brute-force", "password-spraying", "credential-access", "T1110.003"]),
}
