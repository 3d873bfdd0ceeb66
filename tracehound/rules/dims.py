"""Small lookup tables. All of them are fixed in size, so joins against them are broadcast."""

from __future__ import annotations

# Line type -> log type; a line type that is not listed becomes "raw".
LOG_TYPE_OF = {
    "Apache": "apache", "Apache Error": "apache", "NGINX": "nginx", "Nginx Error": "nginx", "Django": "django",
    "Flask": "flask", "Node.js": "express", "Express.js": "express", "Laravel": "laravel",
    "Ruby on Rails": "rails", "Gunicorn": "gunicorn", "Uvicorn": "uvicorn", "FastAPI": "fastapi", "IIS": "iis",
    "Postfix": "postfix", "Sendmail": "sendmail", "Exim": "exim", "Dovecot": "dovecot", "iptables": "iptables",
    "UFW": "ufw", "nftables": "nftables", "firewalld": "firewalld", "Palo Alto Firewall": "palo_alto",
    "FortiGate": "fortigate", "Cisco ASA": "cisco_asa", "Check Point Firewall": "checkpoint",
    "AWS VPC Flow Logs": "aws_vpc_flow", "Azure NSG Flow Logs": "azure_nsg", "GCP VPC Firewall": "gcp_vpc",
    "MySQL Error": "mysql_error", "MySQL Query": "mysql_query", "MySQL Slow Query": "mysql_slow",
    "PostgreSQL Error": "postgres_error", "PostgreSQL Auth": "postgres_auth",
    "PostgreSQL Statement": "postgres_statement", "Oracle Alert": "oracle_alert",
    "Oracle Listener": "oracle_listener", "Oracle Audit": "oracle_audit", "SQL Server Error": "sqlserver_error",
    "SQL Server Audit": "sqlserver_audit", "SQL Server Transaction": "sqlserver_transaction",
    "MongoDB Server": "mongodb_server", "MongoDB Audit": "mongodb_audit", "Linux SSHD Failed": "ssh_auth",
    "Linux SSHD Accepted": "ssh_auth", "Linux Syslog": "syslog", "Linux Systemd": "systemd",
    "Linux Kernel": "kernel", "Linux Audit": "audit", "Windows Event": "windows_event",
    "Windows Security": "windows_security", "Windows Application": "windows_application",
    "Windows System": "windows_system", "VSFTPD": "vsftpd", "ProFTPD": "proftpd", "FileZilla FTP": "vsftpd",
    "IIS FTP": "iis_ftp", "xferlog": "vsftpd", "DHCP": "dhcp", "DNS": "dns", "Proxy": "proxy",
    "Cloudflare": "cloudflare", "AWS CloudTrail": "cloudtrail", "AWS GuardDuty": "aws_guardduty",
    "Azure Activity": "azure_activity", "GCP Audit": "gcp_audit", "Kubernetes": "kubernetes",
    "Docker": "docker", "Elasticsearch": "elasticsearch", "Redis": "redis", "RabbitMQ": "rabbitmq",
    "Kafka": "kafka", "Zookeeper": "zookeeper", "Squid": "squid", "Suricata": "suricata", "Zeek": "zeek",
    "Ossec": "ossec", "Fail2ban": "fail2ban", "Auth0": "auth0",
}

# Log source -> its log types; any other log type belongs to "other".
LOG_SOURCES = {
    "auth": ["ssh_auth", "pam", "vsftpd", "proftpd"],
    "web": ["apache", "nginx", "iis", "django", "flask", "rails", "express", "fastapi", "gunicorn", "uvicorn"],
    "database": ["mysql_error", "mysql_query", "mysql_slow", "postgres_error", "postgres_auth",
                 "postgres_statement", "oracle_alert", "oracle_listener", "oracle_audit", "sqlserver_error",
                 "sqlserver_audit", "sqlserver_transaction", "mongodb_server", "mongodb_audit"],
    "firewall": ["iptables", "ufw", "nftables", "firewalld", "windows_firewall", "palo_alto", "fortigate",
                 "cisco_asa", "checkpoint", "aws_vpc_flow", "azure_nsg", "gcp_vpc"],
    "system": ["syslog", "systemd", "kernel", "audit", "package", "cron", "daemon", "windows_security",
               "windows_system", "windows_application"],
    "mail": ["postfix", "sendmail", "exim", "dovecot", "exchange"],
    "network": ["dns", "dhcp", "proxy"],
}

# Category of a log type, first pattern that is found in the lower-cased name; else "generic".
CATEGORY_PATTERNS = [
    ("webserver", r"apache|nginx|iis|express|django|flask|fastapi|laravel|rails|gunicorn|uvicorn|node|caddy|haproxy|spring|asp\.net"),
    ("authentication", r"ssh|auth|login|sshd|windows.*security"),
    ("firewall", r"firewall|iptables|ufw|nftables|palo|fortigate|cisco|checkpoint|aws.*vpc|azure.*nsg|gcp.*vpc"),
    ("database", r"mysql|postgres|oracle|sql.*server|mongodb"),
    ("mail", r"postfix|sendmail|exim|dovecot|courier|exchange|smtp|mail"),
    ("cloud", r"cloudtrail|guardduty|azure.*activity|gcp.*audit|kubernetes|docker"),
    ("security", r"suricata|zeek|ossec|fail2ban"),
    ("syslog", r"syslog|systemd|kernel|audit"),
]

# Tactics and techniques of an attack type as used by the correlation chains.
CHAIN_MITRE = {
    "bruteforce": (["TA0006 - Credential Access", "TA0001 - Initial Access"], ["T1110 - Brute Force"]),
    "password_spray": (["TA0006 - Credential Access", "TA0001 - Initial Access"], ["T1110 - Brute Force"]),
    "sql_injection": (["TA0006 - Credential Access", "TA0002 - Execution"], ["T1190 - Exploit Public-Facing Application"]),
    "xss_attack": (["TA0006 - Credential Access", "TA0002 - Execution"], ["T1190 - Exploit Public-Facing Application"]),
    "command_injection": (["TA0001 - Initial Access", "TA0002 - Execution"], ["T1059 - Command and Scripting Interpreter"]),
    "path_traversal": (["TA0006 - Credential Access", "TA0007 - Discovery"], ["T1083 - File and Directory Discovery"]),
    "file_inclusion": (["TA0006 - Credential Access", "TA0002 - Execution"], ["T1190 - Exploit Public-Facing Application"]),
    "privilege_escalation": (["TA0004 - Privilege Escalation"], ["T1068 - Exploitation for Privilege Escalation"]),
    "lateral_movement": (["TA0008 - Lateral Movement"], ["T1021 - Remote Services"]),
    "data_exfiltration": (["TA0010 - Exfiltration"], ["T1041 - Exfiltration Over C2"]),
    "ransomware": (["TA0040 - Impact"], ["T1486 - Data Encrypted for Impact"]),
    "webshell": (["TA0003 - Persistence", "TA0002 - Execution"], ["T1505 - Server Software Component"]),
    "c2_communication": (["TA0011 - Command and Control"], ["T1071 - Application Layer Protocol"]),
    "account_takeover": (["TA0006 - Credential Access", "TA0001 - Initial Access"], ["T1078 - Valid Accounts"]),
    "mfa_bypass": (["TA0006 - Credential Access"], ["T1556 - Modify Authentication Process"]),
    "mfa_fatigue": (["TA0006 - Credential Access"], ["T1556 - Modify Authentication Process"]),
    "session_hijacking": (["TA0006 - Credential Access"], ["T1550 - Steal Application Access Token"]),
    "credential_stuffing": (["TA0006 - Credential Access"], ["T1110 - Brute Force"]),
    "malware_activity": (["TA0002 - Execution", "TA0003 - Persistence"], ["T1204 - User Execution"]),
    "insider_threat": (["TA0003 - Persistence", "TA0010 - Exfiltration"], ["TA0003 - Persistence"]),
    "reconnaissance": (["TA0043 - Reconnaissance"], ["T1595 - Gather Victim Host Information"]),
    "port_scan": (["TA0043 - Reconnaissance"], ["T1046 - Network Service Discovery"]),
    "ddos": (["TA0040 - Impact"], ["T1498 - Network Denial of Service"]),
}
CHAIN_MITRE_DEFAULT = (["TA0006 - Credential Access"], ["T1059 - Command and Scripting Interpreter"])

# Tactics shown on alerts.
ALERT_TACTICS = {
    "bruteforce": ["Credential Access"], "credential_stuffing": ["Credential Access"],
    "sql_injection": ["Initial Access", "Execution"], "xss_attack": ["Initial Access"],
    "path_traversal": ["Initial Access", "Exfiltration"], "port_scan": ["Reconnaissance"],
    "threat_intel": ["Reconnaissance"], "anomaly": ["Suspicious Activity"],
    "spam_activity": ["Resource Hijacking"],
}

# Tactic and technique ids used by category tagging.
TAG_MITRE = {
    "sql_injection": ("TA0006", "T1190"), "xss_attack": ("TA0006", "T1189"), "command_injection": ("TA0002", "T1059"),
    "path_traversal": ("TA0006", "T1083"), "ssrf_attack": ("TA0001", "T1190"), "xxe_attack": ("TA0001", "T1059"),
    "ldap_injection": ("TA0006", "T1213"), "deserialization": ("TA0001", "T1059"),
    "log4shell": ("TA0001", "T1190,T1059"), "prototype_pollution": ("TA0001", "T1059"),
    "file_inclusion": ("TA0001", "T1190"), "webshell": ("TA0003", "T1505.003"), "bruteforce": ("TA0006", "T1110"),
    "password_spray": ("TA0006", "T1110.003"), "credential_stuffing": ("TA0006", "T1110.004"),
    "privilege_escalation": ("TA0004", "T1078"), "lateral_movement": ("TA0008", "T1021"),
    "account_takeover": ("TA0006", "T1098"), "kerberoasting": ("TA0006", "T1558.003"),
    "pass_the_hash": ("TA0008", "T1550.002"), "port_scan": ("TA0043", "T1595.001"), "ddos": ("TA0040", "T1498"),
    "reconnaissance": ("TA0043", "T1595"), "c2_communication": ("TA0011", "T1071"),
    "data_exfiltration": ("TA0010", "T1041"), "malware_activity": ("TA0002", "T1204"),
    "cryptomining": ("TA0004", "T1496"), "ransomware": ("TA0040", "T1486"), "insider_threat": ("TA0004", "T1078"),
    "supply_chain": ("TA0001", "T1195"), "dns_tunneling": ("TA0010", "T1071.004"),
}

# Advice per attack type.
ADVICE = {
    "bruteforce": "Implement account lockout policies. Use strong passwords. Enable MFA.",
    "password_spray": "Monitor for unusual login patterns. Block suspicious IPs. Use MFA.",
    "sql_injection": "Review input validation. Use prepared statements. Patch vulnerabilities.",
    "xss_attack": "Implement CSP headers. Sanitize user inputs. Use framework security features.",
    "command_injection": "Avoid system() calls. Use parameterized commands. Validate all inputs.",
    "privilege_escalation": "Review sudo/admin permissions. Enable LSA protection. Monitor admin activity.",
    "lateral_movement": "Implement network segmentation. Restrict remote access. Monitor authentication patterns.",
    "data_exfiltration": "Block unusual data transfers. Implement DLP. Monitor DNS queries.",
    "ransomware": "CRITICAL: Restore from backups immediately. Isolate affected systems. Do not pay ransom.",
    "webshell": "Remove webshell files. Review web server logs. Check file integrity.",
    "c2_communication": "Block suspicious domains. Implement DNS filtering. Investigate hosts.",
    "account_takeover": "Force password reset for compromised accounts. Review recent activity. Enable MFA.",
}
ADVICE_DEFAULT = "Review the attack chain. Implement defense-in-depth. Enable enhanced monitoring."
EXTRA_ADVICE = {
    "bruteforce": "Consider implementing rate limiting on authentication endpoints",
    "sql_injection": "Review and patch all web application inputs",
}
COMPLETED_ADVICE = "CRITICAL: Immediate investigation required - attack completed"
NO_FINDING_ADVICE = "No anomalies detected in the provided logs"

# Catalogue of attack types.
ATTACK_CATALOGUE = {
    "bruteforce": "Multiple failed login attempts to same account",
    "password_spray": "Same password tried against multiple accounts",
    "credential_stuffing": "Automated login attempts with stolen credentials",
    "mfa_bypass": "Attempts to circumvent multi-factor authentication",
    "mfa_fatigue": "Repeated MFA push notifications to exhaust user",
    "session_hijacking": "Unauthorized use of valid session tokens",
    "privilege_escalation": "Attempts to gain elevated access",
    "lateral_movement": "Movement between systems in network",
    "data_exfiltration": "Unauthorized data transfer out of network",
    "sql_injection": "SQL commands injected into application",
    "xss_attack": "Cross-site scripting attack",
    "path_traversal": "Directory traversal to access restricted files",
    "command_injection": "OS commands injected into application",
    "port_scan": "Network reconnaissance scanning ports",
    "ddos": "Distributed denial of service attack",
    "reconnaissance": "Information gathering activity",
    "malware_activity": "Potential malware execution detected",
    "c2_communication": "Command and control server communication",
    "insider_threat": "Suspicious activity from authorized user",
    "account_takeover": "Unauthorized account access",
    "log4shell": "Log4j JNDI injection (CVE-2021-44228)",
    "file_inclusion": "Remote/Local file inclusion",
    "ssrf_attack": "Server-side request forgery",
    "xxe_attack": "XML external entity injection",
}

# Stage of an attack type; brute force and spray depend on success.
STAGES = {
    "sql_injection": "execution", "xss_attack": "execution", "command_injection": "execution",
    "privilege_escalation": "privilege_escalation", "lateral_movement": "lateral_movement",
    "data_exfiltration": "exfiltration", "ransomware": "complete", "webshell": "persistence",
    "c2_communication": "execution", "ddos": "execution",
}

SEVERITY_SCORE = {"critical": 1.0, "high": 0.8, "error": 0.6, "warning": 0.4, "info": 0.2, "debug": 0.1, "unknown": 0.2}
SEVERITY_CODE = {"debug": 0, "info": 1, "warning": 2, "error": 3, "critical": 4}
REPORT_SEVERITIES = ["critical", "high", "error", "warning", "medium", "low", "info", "debug", "unknown"]

# Windows event ids of the security channel -> action, and those that count as failures.
EVENT_ACTIONS = {
    4624: "logon_success", 4625: "logon_failure", 4634: "logoff", 4648: "explicit_logon", 4672: "admin_logon",
    4688: "process_create", 4689: "process_exit", 4696: "token_duplicate", 4720: "user_created",
    4722: "user_enabled", 4723: "password_change", 4724: "password_reset", 4725: "user_disabled",
    4726: "user_deleted", 4738: "user_changed", 4740: "account_locked", 4767: "account_unlocked",
    4768: "tgt_request", 4769: "tgs_request", 4771: "preauth_failure", 4776: "cred_validate",
}
EVENT_FAILURES = [4625, 4648, 4767, 4771, 4776]
EVENT_LEVELS = {"0": "LogAlways", "1": "Critical", "2": "Error", "3": "Warning", "4": "Information", "5": "Verbose"}

# Change-journal reason bits.
USN_REASONS = {
    0x00000001: "DATA_OVERWRITE", 0x00000002: "DATA_EXTEND", 0x00000004: "DATA_TRUNCATION",
    0x00000010: "NAMED_DATA_OVERWRITE", 0x00000020: "NAMED_DATA_EXTEND", 0x00000040: "NAMED_DATA_TRUNCATION",
    0x00000100: "FILE_CREATE", 0x00000200: "FILE_DELETE", 0x00000400: "EA_CHANGE", 0x00000800: "SECURITY_CHANGE",
    0x00001000: "RENAME_OLD_NAME", 0x00002000: "RENAME_NEW_NAME", 0x00004000: "INDEXABLE_CHANGE",
    0x00008000: "BASIC_INFO_CHANGE", 0x00010000: "HARD_LINK_CHANGE", 0x00020000: "COMPRESSION_CHANGE",
    0x00040000: "ENCRYPTION_CHANGE", 0x00080000: "OBJECT_ID_CHANGE", 0x00100000: "REPARSE_POINT_CHANGE",
    0x00200000: "STREAM_CHANGE", 0x00400000: "TRANSACTED_CHANGE", 0x80000000: "CLOSE",
}
USN_CREATE, USN_DELETE, USN_RENAME, USN_WRITE = 0x100, 0x200, 0x3000, 0x11
FILE_REF_MASK = 0xFFFFFFFFFFFF

# Event ids that say something about a file, by kind.
FILE_EVENT_KINDS = {
    "process": [4688], "scheduled_task": [4697, 4698, 4699, 4700, 4702], "file_object": [4656, 4663],
    "file_specific": [4696, 5140, 5145],
}

# Transaction-log operation views.
LSN_VIEWS = {
    "set_file_information": [0x05, 0x06, 0x14, 0x15, 0x03, 0x04],
    "metadata_modification": [0x05, 0x06, 0x07, 0x08, 0x09, 0x0A],
    "rename": [0x06],
    "timestamp_modification": [0x09, 0x0A],
}

# Dataset categories -> attack types.
FLOW_TYPES = {
    "unsw_nb15": {
        "Normal": "normal", "Fuzzers": "fuzzing", "Analysis": "reconnaissance", "Backdoor": "backdoor",
        "DoS": "ddos", "Exploits": "command_injection", "Generic": "unknown", "Reconnaissance": "reconnaissance",
        "Shellcode": "command_injection", "Worms": "malware",
    },
    "cicids2017": {
        "BENIGN": "normal", "FTP-Patator": "bruteforce", "SSH-Patator": "bruteforce", "DoS slowloris": "ddos",
        "DoS Slowhttptest": "ddos", "DoS Hulk": "ddos", "DoS GoldenEye": "ddos", "Heartbleed": "exploit",
        "Web Attack - Brute Force": "bruteforce", "Web Attack - XSS": "xss_attack",
        "Web Attack - SQL Injection": "sql_injection", "Infiltration": "lateral_movement",
        "Bot": "c2_communication", "PortScan": "port_scan", "DDoS": "ddos",
    },
}

# Where Windows and Linux keep their logs, and log files known by name.
WINDOWS_LOG_PATHS = ["windows/system32/winevt/logs", "windows/system32/winevt", "windows/logs", "windows/inf",
                     "windows/debug", "windows/temp", "programdata/microsoft/windows/wer",
                     "programdata/microsoft/windows/wdi"]
LOG_FILE_NAMES = ["setupact.log", "setuperr.log", "dism.log", "cbs.log", "windowsupdate.log", "setupapi.dev.log",
                  "auth.log", "syslog", "kern.log", "messages", "secure", "daemon.log", "cron", "mail.log",
                  "boot.log", "dmesg", "wtmp", "btmp", "lastlog"]

# Evidence searched in artifact listings, (kind, listing, type, severity, pattern).
EVIDENCE = [
    ("timestomping", "timeline", "zero_timestamp", "medium", r"00-00-0000|00-00-00"),
    ("shadow_copy", "shadow_copies", "no_shadow_copies", "medium", r"No shadow copy"),
    ("shadow_copy", "timeline", "shadow_command", "high", r"(?i)vssadmin|shadow copy"),
    ("hidden_streams", "hidden_structures", "stream", "medium", r"(^|\s)[^:\s$]+:[^:\s$]+(\s|$)"),
    ("hidden_streams", "hidden_structures", "downloaded_file", "low", r"Zone\.Identifier"),
    ("log_clearing", "timeline", "log_command", "high", r"(?i)wevtutil|clear-log|eventlog|\.log"),
    ("log_clearing", "logs", "cleared", "critical", r"(?i)cleared|wevtutil"),
    ("registry", "registry", "cleanup_tool", "high", r"(?i)ccleaner|bleachbit|evidence|eliminator|wiper|eraser|privacy"),
    ("file_deletion", "mft", "orphan", "medium", r"\$OrphanFiles"),
    ("file_deletion", "mft", "deleted_entry", "low", r"-/"),
    ("file_deletion", "mft", "recycle_bin", "low", r"RECYCLER|Recycle\.Bin"),
    ("mft_anomaly", "mft", "odd_path", "low", r"(?i)temp|tmp|appdata|local\\temp|downloads|recent|prefetch"),
    ("journal", "usn_journal", "missing", "high", r"No USN journal"),
]
