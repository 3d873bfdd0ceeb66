"""How a line is recognised.

Each row is (type name, kind, test). Kinds: ``re`` matches from the start of the line, ``find`` anywhere;
``json`` accepts any JSON value, ``array`` a non-empty JSON array, ``keys`` a JSON object holding all the
named top-level keys, ``keys_find`` also the pattern; ``has`` any of the plain substrings; ``cell`` a comma-separated line with the given
cell. The row order is the priority order.
"""

from __future__ import annotations

RAW = "Custom / Raw"

# Type names, their order and their patterns decide which type a line gets.
LINE_TESTS: list[tuple[str, str, object]] = [
    ("Apache", "re", r'\S+ - - \[.*?\] ".*?" \d+ \S+'),
    ("Apache Error", "re", r"^\[.*?\] \[.*?:.*?\] \[pid \d+(:tid \d+)?\] .*"),
    ("NGINX", "re", r'\S+ - \S+ \[.*?\] ".*?" \d+ \d+'),
    ("Django", "re", r'\[.*?\] "\w+ /\S+" \d+'),
    ("Flask", "re", r'\[[\d/\-]+ [\d:]+\] "\w+ \S+ \S+" \d+|\* (Running on|Restarting)|http://\d+\.\d+\.\d+\.\d+|^((GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+/\S+\s+\d{3}$)'),
    ("Node.js", "re", r"\w+ /\S+ \d+ \d+ms"),
    ("MongoDB Server", "json", None),
    ("Express.js", "re", r"^\{"),
    ("Laravel", "re", r"\[\d{4}-\d{2}-\d{2} .*?\] \w+\.\w+:"),
    ("Ruby on Rails", "has", ["Processing by", "Started GET"]),
    ("Gunicorn", "re", r"\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}.*\] \[\d+\] \[(INFO|ERROR|WARNING)\]"),
    ("Uvicorn", "re", r'INFO:\s+.* - "\w+ .* HTTP/\d\.\d" \d{3}'),
    ("PHP-FPM", "find", r"\[pool |^\] (NOTICE|WARNING|ERROR):"),
    ("FastAPI", "re", r'^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}\.\d+.*?(INFO|WARNING|ERROR|DEBUG).*?"(GET|POST|PUT|DELETE|PATCH)\s+\S+\s+HTTP/\d\.\d"\s+\d{3}'),
    ("aiohttp", "re", r'^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\s+(INFO|WARNING|ERROR|DEBUG).*"(GET|POST|PUT|DELETE)\s+\S+\s+\d{3}"'),
    ("Starlette", "re", r'^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\s+(INFO|WARNING|ERROR|DEBUG).*"(GET|POST|PUT|DELETE|PATCH)\s+\S+\s+\d{3}"'),
    ("Caddy", "re", r"^(?:\d{1,3}\.){3}\d{1,3}\s+-\s+-\s+\[INFO\]\s+http\.log:\s+handled\s+(GET|POST|PUT|DELETE)\s+\S+\s+\d{3}$"),
    ("HAProxy", "re", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+haproxy\[\d+\]:\s+(?:GET|POST|PUT|DELETE)\s+\S+\s+\d{3}$"),
    ("Spring Boot", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\s+(?:INFO|WARN|ERROR|DEBUG)\s+\S+\s+-\s+(?:GET|POST|PUT|DELETE|PATCH)\s+\S+\s+\d{3}$"),
    ("ASP.NET Core", "re", r"^(?:info|warn|error|debug):\s+Microsoft\.AspNetCore"),
    ("IIS", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+\d{1,3}(?:\.\d{1,3}){3}\s+(GET|POST|PUT|DELETE)\s+/\S*\s+.*\s+\d{3}\s*"),
    ("Postfix", "re", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+(postfix/(smtpd|smtp|cleanup|qmgr|pipe|submission/smtpd|10025/smtpd|anvil|postscreen|bounce|dnsblog|amavis/smtp)|amavis|opendkim|roundcube)\[?\d*\]?:\s+.+$"),
    ("Sendmail", "re", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+sendmail\[\d+\]:\s+.+$"),
    ("Exim", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+[A-Z0-9]{6,}\s+(<=|=>|\*\*)\s+\S+.*$"),
    ("Dovecot", "re", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+dovecot:\s+(imap|pop3)-login:\s+.+$"),
    ("Courier", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+courier(?:imap|pop3):\s+(?:LOGIN|LOGOUT),\s+user="),
    ("Microsoft Exchange", "re", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z,SMTP(Receive|Send|Deliver),.+$"),
    ("SMTP Server", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+SMTP\s+(connect|disconnect|from=|to=).+$"),
    ("Amavis", "re", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+amavis\[\d+\]:\s+.+$"),
    ("SpamAssassin", "re", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+spamd\[\d+\]:\s+.+$"),
    ("MailScanner", "re", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+MailScanner\[\d+\]:\s+.+$"),
    ("Windows Firewall", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+(ALLOW|DROP|BLOCK)\s+(TCP|UDP|ICMP)\s+(?:\d{1,3}\.){3}\d{1,3}\s+(?:\d{1,3}\.){3}\d{1,3}\s+\d+\s+\d+.*$"),
    ("Windows Event Viewer", "re", r"^(Audit (?:Success|Failure|Error|Warning)|Success|Failure|Error|Warning)[ \t]\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}[ \t]"),
    ("Windows Application TXT", "re", r"^(Information|Warning|Error|Critical)\t\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}\t|^Level\tDate and Time\tSource\tEvent ID\tTask Category"),
    ("Windows Security CSV", "cell", ("TimeCreated,EventID,LevelDisplayName,LogName,MachineName,Message,AccountName,LogonType,IpAddress", 9, 3, "Security", "TimeCreated")),
    ("Windows Application CSV", "re", r"^(Information|Warning|Error|Critical),\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2},[^,]+,\d+,[^,]+,|^(Audit (?:Success|Failure|Error|Warning)),\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2},[^,]+,\d+,[^,]+,|^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2},\d+,[^,]+,[^,]+,[^,]+,|^(Level|Keywords|TimeCreated),"),
    ("Windows Event", "re", r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s*,?\s*(INFO|WARNING|ERROR|DEBUG)\s*,?\s*(\S+)\s*,?\s*(\d+)\s*,?\s*(.*)"),
    ("Windows Security", "re", r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(INFO|WARNING|ERROR)\s+Security\s+(\d+)\s+(?:User:\s*(\S+))?\s*(.*)?"),
    ("Windows Application", "re", r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(INFO|WARNING|ERROR)\s+Application\s+(\d+)\s+(?:Product:\s*(\S+))?\s+(?:EventCode:\s*(\d+))?\s*(.*)?"),
    ("Windows System", "re", r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(INFO|WARNING|ERROR)\s+System\s+(\d+)\s+(?:Source:\s*(\S+))?\s*(.*)?"),
    ("Windows Setup", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+Setup\s+\d+\s+(INFO|WARNING|ERROR|CRITICAL)"),
    ("Windows Forwarded Events", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+ForwardedEvents\s+\d+\s+(INFO|WARNING|ERROR|CRITICAL)"),
    ("Windows Text", "re", r"(\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}),\s*([^,]+),\s*([^,]+),\s*(\d+),\s*(.*)"),
    ("iptables", "re", r"(?i)^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+kernel:\s*(?:\[[\d.]+\])?\s*IPTABLES-(DROP|ACCEPT):\s+IN=\S*\s+OUT=\S*\s+.*SRC=(?:\d{1,3}\.){3}\d{1,3}\s+DST=(?:\d{1,3}\.){3}\d{1,3}.*PROTO=(TCP|UDP|ICMP).*$"),
    ("UFW", "re", r"(?i)^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+kernel:\s*\[\d+\.\d+\]\s*\[UFW (ALLOW|BLOCK)\]\s+IN=\S*\s+OUT=\S*\s+SRC=(?:\d{1,3}\.){3}\d{1,3}\s+DST=(?:\d{1,3}\.){3}\d{1,3}"),
    ("nftables", "re", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+kernel:\s+nftables:\s+rule\s+(accept|drop|reject)\s+.*(tcp|udp|icmp).*$"),
    ("firewalld", "re", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+firewalld:\s+(INFO|WARNING|ERROR):\s+.*$"),
    ("macOS PF", "re", r"^\d{2}:\d{2}:\d{2}\.\d+\s+rule\s+\d+/\d+\s+\((?:match)\):\s+(?:block|pass)\s+(?:in|out)\s+on\s+\S+:\s+(?:\d{1,3}\.){3}\d{1,3}\.\d+\s+>\s+(?:\d{1,3}\.){3}\d{1,3}\.\d+.*$"),
    ("macOS App Firewall", "re", r"^Firewall:\s+(?:Blocked|Allowed)\s+(?:incoming|outgoing)\s+connection from\s+(?:\d{1,3}\.){3}\d{1,3}\s+to\s+app\s+\S+.*$"),
    ("Palo Alto Firewall", "re", r"^\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s+(allow|deny|drop)\s+(tcp|udp|icmp)\s+(?:\d{1,3}\.){3}\d{1,3}\s+(?:\d{1,3}\.){3}\d{1,3}\s+rule=\S+.*$"),
    ("FortiGate", "re", r"^date=\d{4}-\d{2}-\d{2}\s+time=\d{2}:\d{2}:\d{2}\s+action=(allow|deny)\s+srcip=(?:\d{1,3}\.){3}\d{1,3}\s+dstip=(?:\d{1,3}\.){3}\d{1,3}.*$"),
    ("Cisco ASA", "re", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+%ASA-\d-\d+:\s+access-list\s+\S+\s+(denied|permitted)\s+(tcp|udp|icmp)\s+\S+/(?:\d{1,3}\.){3}\d{1,3}\s+to\s+\S+/(?:\d{1,3}\.){3}\d{1,3}.*$"),
    ("Check Point Firewall", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+(accept|drop|reject)\s+(TCP|UDP|ICMP)\s+src=(?:\d{1,3}\.){3}\d{1,3}\s+dst=(?:\d{1,3}\.){3}\d{1,3}\s+rule=\S+.*$"),
    ("AWS VPC Flow Logs", "re", r"^(\d+)\s+(\d+)\s+(eni-\S+)\s+(?:(?:\d{1,3}\.){3}\d{1,3})\s+(?:(?:\d{1,3}\.){3}\d{1,3})\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(ACCEPT|REJECT)\s+(\S+)$"),
    ("Azure NSG Flow Logs", "keys_find", (["time", "properties"], r'"flows"\s*:\s*\[.*"flowTuples"\s*:\s*\[')),
    ("GCP VPC Firewall", "re", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\s+(allow|deny)\s+(tcp|udp|icmp)\s+(?:\d{1,3}\.){3}\d{1,3}:\d+\s+(?:\d{1,3}\.){3}\d{1,3}:\d+.*$"),
    ("Disk Traffic", "find", r'type="traffic"'),
    ("Moodle LMS", "re", r'^\[\["19(?:\\/)?\d{2}(?:\\/)?\d{2},\s+\d{2}:\d{2}"'),
    ("Application Logs JSON", "array", None),
    ("MySQL Error", "re", r"(\d{4}-\d{2}-\d{2}T[\d:.]+Z?)\s+(\d+)\s+\[(ERROR|Warning|Note)\]\s+\[MY-(\d+)\]\s+\[(\w+)\]\s+(.*)"),
    ("MySQL Query", "re", r"^\d{4}-\d{2}-\d{2}T[\d:.]+Z?\s+\d+\s+(Query|Connect|Execute)\s+"),
    ("MySQL Slow Query", "re", r"^# Time:"),
    ("PostgreSQL Error", "re", r"^\d{4}-\d{2}-\d{2}\s+[\d:.]+\s+UTC\s+\[\d+\]\s+\S+\s+(LOG|ERROR|FATAL|PANIC):\s*(.*)$"),
    ("PostgreSQL Auth", "re", r"^\d{4}-\d{2}-\d{2}\s+[\d:.]+\s+UTC\s+\[\d+\]\s+\S+\s+LOG:\s+connection received:.*host=(\d+\.\d+\.\d+\.\d+)\s+port=(\d+)"),
    ("PostgreSQL Statement", "re", r"^\d{4}-\d{2}-\d{2}\s+[\d:.]+\s+[A-Za-z]{3,4}(?:/[A-Za-z]+)?\s+\[\d+\]\s+STATEMENT:\s+(.*);"),
    ("Oracle Alert", "re", r"^[A-Za-z]{3}\s+[A-Za-z]{3}\s+\d{2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}"),
    ("Oracle Listener", "re", r"(.*?)\s+\*.*SERVICE_NAME=(\w+).*PROTOCOL=(\w+).*HOST=(\d+\.\d+\.\d+\.\d+).*PORT=(\d+).*\*\s+(\d+)"),
    ("Oracle Audit", "re", r"^Audit trail:"),
    ("SQL Server Error", "re", r"(.*?) Server Error: (\d+), Severity: (\d+), State: (\d+)"),
    ("SQL Server Audit", "re", r"(?i)action_id=\w+.*(?:name=\S+|database_name=\S+|statement=.*)"),
    ("SQL Server Transaction", "re", r"\((\d+):(\d+):(\d+)\).*Operation:\s+(.*)"),
    ("MongoDB Audit", "keys", ["atype", "ts"]),
    ("Linux SSHD Failed", "re", r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[\d+\]:\s+Failed\s+\w+\s+for\s+(?:invalid\s+user\s+)?(\S+)\s+from\s+(\d{1,3}(?:\.\d{1,3}){3})\s+port\s+(\d+)"),
    ("Linux SSHD Accepted", "re", r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[\d+\]:\s+Accepted\s+\w+\s+for\s+(\S+)\s+from\s+(\d{1,3}(?:\.\d{1,3}){3})\s+port\s+(\d+)"),
    ("Linux Syslog", "re", r"(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w\-/]+)\[(\d+)\]:\s+(.*)"),
    ("Linux Systemd", "re", r"(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+systemd\[(\d+)\]:\s+(.*)"),
    ("Linux Kernel", "re", r"(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+kernel:\s+(.*)"),
    ("Linux Audit", "re", r"type=(\w+)\s+msg=audit\((\d+)\.\d+:(\d+)\):\s*(.*)"),
    ("Linux Package", "re", r"(\d{4}-\d{2}-\d{2})\s+\d{2}:\d{2}:\d{2}\s+(status|configure|install|trigproc|upgrade)\s+"),
    ("FileZilla FTP", "re", r"^\((\d+)\)(\d{2}/\d{2}/\d{4}) (\d{2}:\d{2}:\d{2}) - (\S+) \(([\d.]+)\)> (\d+) (.*)$"),
    ("IIS FTP", "re", r"(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+([\d\.]+)\s+([\w\-]+)\s+[\d\.]+\s+\d+\s+(\w+)\s+([\S]*)\s+(\d+)"),
    ("xferlog", "re", r"(\w{3})\s+(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\d{4})\s+\d+\s+([\d.]+)\s+\d+\s+(\S+)\s+[ab]\s+[_]\s+([io])\s+[ra]\s+(\S+)\s+\w+\s+[01]\s+\*\s+([ci])"),
    ("VSFTPD", "re", r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+vsftpd\[(\d+)\]:\s+\[([^\]]+)\]\s+(OK|FAIL)\s+(\w+):\s+(.*)$"),
    ("ProFTPD", "re", r"^(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(?:proftpd|pure-ftpd)\[\d+\]:\s+(.*)"),
    ("DHCP", "re", r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+(?:dhcpd?|dhclient)\[\d+\]:\S*\s+.*"),
    ("DNS", "re", r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+(?:named|bind|dnsmasq|unbound)\[\d+\]:\S*\s+.*"),
    ("Proxy", "re", r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+(?:squid|haproxy|nginx|microsocks)\[\d+\]:\S*\s+.*"),
    ("Cloudflare", "keys", ["timestamp", "Edge", "Request"]),
    ("AWS CloudTrail", "keys", ["eventTime", "eventName", "awsRegion"]),
    ("AWS GuardDuty", "keys", ["schemaVersion", "accountId", "type", "severity"]),
    ("Azure Activity", "keys", ["time", "operationName", "resource", "status"]),
    ("GCP Audit", "keys", ["protoPayload", "methodName", "resourceName"]),
    ("Kubernetes", "keys", ["log", "stream", "docker"]),
    ("Docker", "keys", ["log", "stream", "time"]),
    ("Elasticsearch", "keys", ["type", "timestamp", "level", "message"]),
    ("Redis", "re", r"^\d+:[\sM]\s+\d+\s+\w+\s+\d+\s+\w+\s+\d{2}:\d{2}:\d{2}\.\d+\s+\S+\s+.*"),
    ("RabbitMQ", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\s+\[info\]\s+<\d+\.\d+>.*"),
    ("Kafka", "re", r"^\[\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2},\d+\s+\w+\]\s+.*"),
    ("Zookeeper", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\s+\[myid:\d+\]\s+-\s+\w+\s+\[.*\]\s+.*"),
    ("Nginx Error", "re", r"^\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s+\[(\w+)\]\s+\d+#\d+:\s+.*"),
    ("Squid", "re", r"^\d+\.\d+\s+\d+\s+(?:\d{1,3}\.){3}\d{1,3}\s+\S+/\d+\s+\d+\s+\S+\s+\S+\s+\S+\s+\S+.*"),
    ("Suricata", "re", r"^\[\d+:\d+:\d+\]\s+\S+\s+\S+\s+\[Classification:.*\]\[Priority:\d+\]\s+\{.*\}.*"),
    ("Zeek", "re", r"^\d+\.\d+\s+\S+\s+(?:\d{1,3}\.){3}\d{1,3}\s+\d+\s+(?:\d{1,3}\.){3}\d{1,3}\s+\d+\s+\S+\s+.*"),
    ("Ossec", "re", r"^\*\*Alert \d+\.\d+\s+-\s+\S+\s+\S+\s+-\s+Rule:\s+\d+\s+-\s+Level:\s+\d+\s+-\s+.*"),
    ("Fail2ban", "re", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2},\d+\s+\w+\s+\[\d+\]:\s+\w+\s+\[\S+\]\s+.*"),
    ("Auth0", "re", r"^\d{2}/\w+/\d{4}:\d{2}:\d{2}:\d{2}\s+\S+\s+\[\d+\]\s+\[\w+\]:.*"),
    ("Apache Combined", "re", r'^\S+\s+-\s+-\s+\[.*?\]\s+".*?"\s+\d+\s+\d+\s+".*?"\s+".*?"'),
]

TYPE_NAMES: list[str] = [name for name, _, _ in LINE_TESTS]


def start_anchored(pattern: str) -> str:
    """Pattern text that has to match from the first character, whatever its alternatives."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flag}^(?:{pattern[len(flag):]})"


# Openings of a new log entry, and of a line that continues the one before.
ENTRY_OPENINGS = [
    r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}",
    r"^\d{10,13}(\.\d+)?\s",
    r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"(?i)^(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL|TRACE)\s*[\[:\-]",
    r"^\[\d{4}[-/]\d{2}[-/]\d{2}",
    r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s+\S+\s+\S+\s+\[",
    r'^\{\s*"(timestamp|time|ts|date)"\s*:',
    r"(?i)^\d{4}[-\d\s:]+,(Information|Warning|Error|Success|Failure)",
]
CONTINUATIONS = [
    r"^\s+(at|File|line|in)\s+",
    r"^[\t ]{2,}",
    r"(?i)^(Caused by|Exception|Traceback)",
]
BLOCK_OPENINGS = {
    "mysql_slow": r"^# Time:",
    "oracle_alert": r"^[A-Za-z]{3}\s+[A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}\s+\d{4}$",
    "oracle_audit": r"\S",
}
