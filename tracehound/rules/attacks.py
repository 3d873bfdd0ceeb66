"""Attack patterns. All patterns are searched anywhere in the text."""

from __future__ import annotations

# Keyword rules, (attack type, weight, patterns), letter case ignored.
KEYWORD_RULES: list[tuple[str, float, list[str]]] = [
    ("bruteforce", 0.85, [
        r"Failed password", r"authentication failure", r"authentication failed", r"Invalid user",
        r"too many failed attempts", r"SASL.*failed",
    ]),
    ("sql_injection", 0.95, [
        r"' OR '1'='1", r"UNION\s+SELECT", r"DROP\s+TABLE", r"INSERT\s+INTO", r"UPDATE\s+.*\s+SET",
        r"SELECT\s+.*\s+FROM\s+information_schema", r"SELECT\s+.*\s+FROM\s+mysql\.", r"SLEEP\(", r"BENCHMARK\(",
        r"WAITFOR\s+DELAY", r"OR\s+1=1", r"GROUP\s+BY\s+.*\s+HAVING",
    ]),
    ("xss_attack", 0.90, [r"<script>", r"javascript:", r"onerror=", r"onload="]),
    ("threat_intel", 0.80, [r"listed by domain", r"blacklist", r"blocklist", r"denied by policy"]),
    ("spam_activity", 0.60, [r"\[SPAM\]", r"blocked as spam", r"spam score exceeded"]),
]

# Ordered rules, first type with a hit wins, letter case ignored.
ORDERED_RULES: list[tuple[str, list[str]]] = [
    ("sql_injection", [r"union\s+select", r"'\s+or\s+'1'='1", r"'\s+or\s+1=1", r"drop\s+table", r"exec\s*\(",
                       r"xp_cmdshell", r"0x41414141"]),
    ("xss_attack", [r"<script>", r"javascript:", r"onerror=", r"onload=", r"document\.cookie"]),
    ("command_injection", [r";\s*(cat|ls|wget|curl|nc|bash|sh)\s", r"\|\s*(cat|ls|wget|curl|nc|bash|sh)\s",
                           r"`.*`", r"\$\(.*\)", r"chmod\s+\d{3,4}"]),
    ("path_traversal", [r"\.\./", r"\.\.\\", r"%2e%2e", r"etc/passwd", r"win.ini"]),
    ("webshell", [r"\.(php|asp|aspx|jsp)\?cmd=", r"c99|r57|b374k|wso", r"eval\s*\(", r"base64_decode"]),
    ("ransomware", [r"vssadmin.*delete", r"shadowcopy.*delete", r"\.locked", r"bcdedit.*recoverydisabled",
                    r"encrypt.*files"]),
    ("bruteforce", [r"failed\s+password", r"authentication\s+failure", r"invalid\s+user"]),
    ("password_spray", [r"authentication\s+failure", r"unknown\s+user"]),
]

# Rules per category of log, (category, attack type, weight, patterns). Letter case is ignored
# but where a pattern starts with (?-i).
CATEGORY_RULES: list[tuple[str, str, float, list[str]]] = [
    ("webserver", "sql_injection", 0.9, [
        r"""('|"|%27|%22)\s*(OR|AND)\s*('|"|%27|%22)\s*\d*\s*=\s*('|"|%27|%22)\s*\d*""",
        r"(\bUNION\b.*\bSELECT\b|\bSELECT\b.*\bFROM\b)", r";\s*(DROP|DELETE|INSERT|UPDATE|EXEC|EXECUTE)\s+",
        r"(\bWAITFOR\b|\bDELAY\b|\bSLEEP\b|\bBENCHMARK\b)",
        r"(INFORMATION_SCHEMA|sys\.(tables|columns|objects)|pg_catalog)"]),
    ("webserver", "xss_attack", 0.85, [
        r"<script[^>]*>.*?</script>", r"javascript:", r"""on\w+\s*=\s*['"]*[^'">\s]+""",
        r"""<iframe[^>]*src\s*=\s*['"]*javascript:""", r"<svg[^>]*onload\s*=",
        r"(document\.(cookie|location|write)|window\.location)", r"eval\s*\(|setTimeout\s*\(|setInterval\s*\("]),
    ("webserver", "command_injection", 0.9, [
        r"[;|`]\s*(cat|ls|pwd|whoami|id|uname|wget|curl|nc|bash|sh|python|perl)\s",
        r"(?-i)\$\([^)]*\)|`[^`]*`|\$\{[^}]*\}", r"(chmod|chown|rm\s+-rf|mkdir|rmdir)\s+",
        r"(/bin/sh|/bin/bash|/bin/python|cmd\.exe|powershell)"]),
    ("webserver", "path_traversal", 0.8, [
        r"\.\.(/|\\|%2f|%5c|%252f|%255c)", r"(%2e%2e|%252e%252e)",
        r"(/etc/passwd|/etc/shadow|/etc/hosts|/proc/self)", r"(c:\\windows|c:\\boot\.ini|c:\\system32|c:\\inetpub)"]),
    ("webserver", "ssrf_attack", 0.85, [
        r"(169\.254\.169\.254|metadata\.google\.internal|169-254-169-254)",
        r"\?.*(url|uri|path|dest|redirect|next)\s*=\s*https?:", r"(file://|gopher://|dict://|ftp://|ldap://)",
        r"(127\.0\.0\.1|localhost|0\.0\.0\.0|\[::\]|0x7f\.)"]),
    ("webserver", "xxe_attack", 0.85, [
        r"""<!ENTITY\s+[^>]+\s+SYSTEM\s+["'][^"']+["']""", r"<!DOCTYPE\s+[^>]+\s+\[\s*<!ENTITY",
        r"(file://|expect://|php://filter|http://)"]),
    ("webserver", "log4shell", 0.98, [
        r"\$\{jndi:(ldap|ldaps|rmi|dns|iiop)://", r"(?-i)\$\{\$\{[^}]*:-[^}]*\}",
        r"\$\{\s*lower\s*:\s*j\s*\}\s*\{\s*lower\s*:\s*n"]),
    ("webserver", "deserialization", 0.9, [
        r"(rO0|ysoserial|gadgetchain)", r"(?-i)(\x{AC}\x{ED}\x00\x05|H4sIAAAAAAAA)"]),
    ("webserver", "webshell", 0.85, [
        r"(c99|r57|b374k|wso|weevely|alfa|p0wny|mini.*shell)", r"\.(php|asp|aspx|jsp)\?cmd=|\?exec=|\?shell=",
        r"eval\s*\(\s*\$_(GET|POST)|system\s*\(\s*\$|passthru\s*\(\s*\$"]),
    ("webserver", "bruteforce", 0.6, [r"(401|403)\s+.*/login|Failed\s+password|Authentication\s+failure"]),
    ("webserver", "reconnaissance", 0.7, [
        r"(/\.env|/config\.json|/\.git/|/\.htaccess|/phpinfo)",
        r"(nikto|sqlmap|nmap|masscan|zgrab|nuclei|dirbuster|gobuster)"]),
    ("authentication", "bruteforce", 0.75, [
        r"Failed\s+password|Authentication\s+failure|Invalid\s+user|Failed\s+login"]),
    ("authentication", "password_spray", 0.65, [r"(Authentication\s+failure|Invalid\s+user|Unknown\s+user)"]),
    ("authentication", "credential_stuffing", 0.7, [r"(Account\s+locked|Too\s+many\s+attempts|Rate\s+limit)"]),
    ("authentication", "privilege_escalation", 0.8, [
        r"(sudo|su\s+-|sudo\s+-i|sudo\s+su|sudo\s+.*ALL)", r"(SetUser|Privilege\s+escalation|Admin\s+access)",
        r"(useradd|usermod|passwd\s+root)"]),
    ("authentication", "lateral_movement", 0.75, [
        r"(psexec|wmiexec|smbexec|pass\s+the\s+hash)", r"(ssh.*from.*to|scp\s+.*\s+\S+@\S+:\s*)"]),
    ("authentication", "account_takeover", 0.75, [
        r"(impossible\s+travel|unusual\s+location|new\s+device)", r"(suspicious\s+login|account.*compromised)"]),
    ("authentication", "kerberoasting", 0.8, [
        r"(4768.*0x12|4769.*0x17)", r"(krbtgt|ticket_granting|AS-REQ|TGS-REQ)"]),
    ("authentication", "pass_the_hash", 0.8, [r"(NTLM.*hash|pass.the.hash|mimikatz|rubeus)"]),
    ("firewall", "port_scan", 0.75, [
        r"(Connection\s+(refused|timed\s+out)|No\s+route\s+to\s+host)", r"(SYN\s+scan|PORT\s+scan|nmap|masscan)",
        r"multiple\s+ports?\s+scanned"]),
    ("firewall", "ddos", 0.8, [
        r"(Connection\s+reset\s+by\s+peer|Too\s+many\s+connections)", r"(flood|rate\s+limit\s+exceeded|syn\s+flood)"]),
    ("firewall", "reconnaissance", 0.65, [r"(scan|probe|enumerate|discover)"]),
    ("firewall", "c2_communication", 0.7, [
        r"(beacon|heartbeat|check-in|command.*control)", r"dns\s+tunnel|dga|domain\s+generation"]),
    ("firewall", "data_exfiltration", 0.7, [r"(large\s+data\s+transfer|bulk\s+upload|unusual\s+outbound)"]),
    ("firewall", "lateral_movement", 0.7, [r"(internal\s+to\s+internal|east-west\s+traffic)"]),
    ("database", "sql_injection", 0.95, [
        r"(\bUNION\b.*\bSELECT\b|\bSELECT\b.*\bFROM\b)", r";\s*(DROP|DELETE|INSERT|UPDATE|EXEC|EXECUTE)\s+",
        r"(INFORMATION_SCHEMA|sys\.(tables|columns|objects)|pg_catalog)",
        r"(\bWAITFOR\b|\bDELAY\b|\bBENCHMARK\b|\bSLEEP\b)"]),
    ("database", "data_exfiltration", 0.8, [
        r"(SELECT\s+.*\s+INTO\s+OUTFILE|COPY\s+.*\s+TO\s+)", r"(bulk\s+select|bcp\s+.*\s+out)"]),
    ("database", "privilege_escalation", 0.75, [
        r"(GRANT\s+ALL|ALTER\s+USER.*WITH\s+ADMIN)", r"(CREATE\s+USER|ADD\s+MEMBER\s+TO\s+ROLE)"]),
    ("database", "insider_threat", 0.7, [r"(unauthorized.*access|sensitive.*table|customer.*data)"]),
    ("mail", "bruteforce", 0.7, [r"(authentication\s+failed|login\s+failed|535|530)"]),
    ("mail", "data_exfiltration", 0.65, [r"(large\s+attachment|bulk\s+email|mass\s+mailing)"]),
    ("mail", "c2_communication", 0.75, [r"(suspicious\s+attachment|executable.*email|macro)"]),
    ("mail", "reconnaissance", 0.6, [r"(user\s+enumeration|verify\s+email|rcpt\s+to.*multiple)"]),
    ("syslog", "privilege_escalation", 0.8, [
        r"(sudo|su\s+-|sudo\s+-i|sudo\s+su)", r"(chmod\s+.*\+s|setuid|setgid)"]),
    ("syslog", "malware_activity", 0.85, [
        r"(virus|trojan|malware|ransomware|backdoor)", r"(suspicious\s+process|unusual\s+execution)"]),
    ("syslog", "cryptomining", 0.9, [
        r"(xmrig|minerd|cryptonight|stratum\+tcp)", r"(high\s*cpu\s*usage|mining\s*pool)"]),
    ("syslog", "ransomware", 0.95, [
        r"(vssadmin.*delete.*shadows|wmic.*shadowcopy.*delete)", r"(bcdedit.*recoveryenabled.*no)",
        r"\.(encrypted|locked|crypto|crypt|enc)\b"]),
    ("cloud", "privilege_escalation", 0.8, [
        r"(AssumeRole|CreateAccessKey|AttachUserPolicy)", r"(elevate|escalate|admin.*policy)"]),
    ("cloud", "data_exfiltration", 0.75, [
        r"(GetObject.*large|Download\s+data|ExportSnapshot)", r"(unusual\s+data\s+access|bulk\s+download)"]),
    ("cloud", "account_takeover", 0.8, [
        r"(ConsoleLogin.*suspicious|unusual\s+API\s+calls)", r"(impossible\s+travel|unrecognized\s+principal)"]),
    ("cloud", "lateral_movement", 0.75, [r"(cross-account|role.*chaining|AssumeRole.*external)"]),
    ("cloud", "reconnaissance", 0.7, [r"(ListBuckets|DescribeInstances|ListUsers.*rapid)"]),
    ("cloud", "supply_chain", 0.8, [r"(PutBucketPolicy|ModifyLambda|UpdateFunctionCode)"]),
    ("security", "malware_activity", 0.9, [r"(malware.*detected|virus.*found|trojan)"]),
    ("security", "c2_communication", 0.85, [r"(c2.*detected|command.*control|beacon)"]),
    ("security", "port_scan", 0.8, [r"(port\s+scan.*detected|scan\s+alert|reconnaissance)"]),
    ("security", "bruteforce", 0.8, [r"(brute\s+force.*detected|login\s+attack)"]),
    ("generic", "bruteforce", 0.5, [r"(Failed\s+password|Authentication\s+failure)"]),
    ("generic", "malware_activity", 0.7, [r"(virus|trojan|malware)"]),
]

# Patterns behind the attack features, each hit counted over the whole text.
FEATURE_COUNTS: list[tuple[str, str]] = [
    ("sql_hits", r"""(?i)union\s+select|select\s+.*\s+from|drop\s+table|;\s*--|--\s*$|'\s*or\s+'?1'?\s*=\s*'?1|"\s*or\s+"?1"?\s*=\s*"?1|or\s+'1'\s*=\s*'1|or\s+1\s*=\s*1|and\s+1\s*=\s*1|\bor\b.*=.*\bor\b|\band\b.*=.*\band\b"""),
    ("xss_hits", r"(?i)<script|javascript:|on\w+\s*=|<iframe|<object|<embed|alert\(|document\.cookie|document\.location"),
    ("command_hits", r"(?i)[;|`]\s*(cat|ls|wget|curl|nc|bash|sh|whoami|id|uname|pwd|echo|chmod)\s|chmod\s+\d+|wget\s+http|curl\s+http|\$\(|\$\{|`.*`"),
    ("traversal_hits", r"(?i)\.\.(/|\\)|%2e%2e|\.\.\\|%252e%252e|etc/passwd|win\.ini|boot\.ini|\.htaccess|\.htpasswd"),
    ("inclusion_hits", r"(?i)\?(page|file|path|include|document)\s*=.*http|\?.*=.*\.\.|include\s*\(|require\s*\(|require_once\s*\(|virtual\s*\("),
    ("system_path_hits", r"/etc/|/proc/|/var/|/usr/|\\windows\\|\\system32\\"),
]
# Words and yes-or-no patterns behind the attack features.
SENSITIVE_WORDS = ["password", "credential", "token", "secret", "key", "auth"]
FEATURE_FLAGS: list[tuple[str, str]] = [
    ("is_http", r"(?i)\b(get|post|put|delete|patch)\s+/[^\s]*"),
    ("has_url_encoding", r"%[0-9a-fA-F]{2}"),
    ("has_ip", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("has_port", r"port\s+\d+|:\d{2,5}"),
    ("has_angle_brackets", r"<[^>]+>"),
    ("has_single_quote", r"'"),
    ("has_equals_quote", r"""=\s*['"]"""),
    ("has_double_dash", r"--"),
    ("has_semicolon", r";"),
    ("has_pipe", r"\|"),
    ("has_backtick", r"`"),
    ("is_connection", r"connection|port"),
]

# Patterns counted once per entry by the batch classifier.
SUSPICIOUS = [
    r"""(?i)('|"|%27|%22)\s*(OR|AND)\s*('|"|%27|%22)""", r"(?i)\bUNION\s+(?:ALL\s+)?SELECT\b",
    r"(?i);\s*(DROP|DELETE|INSERT|UPDATE|ALTER|TRUNCATE)\b", r"(?i)EXEC\s*\(", r"(?i)xp_cmdshell",
    r"(?i)<script[^>]*>.*?</script>", r"(?i)javascript:", r"""(?i)on\w+\s*=\s*['"]?[^'">\s]+['"]?""",
    r"(?i)\.\./|\.\.\\|%2e%2e/|%2e%2e\\", r"(?i)\$\{.*jndi", r"\$\{.*\}",
    r"(?i)\$\(|`|\|\||chmod\s+.*rf|chown\s+.*\s+|rm\s+-rf\b",
    r"(?i)etc/passwd|etc/shadow|proc/self/environ|boot\.ini|win\.ini",
    r"(?i)169\.254\.169\.254/latest/meta-data|metadata\.google\.internal",
    r"""(?i)password\s*=\s*['"][^'"]+['"]|passwd\s*=\s*['"][^'"]+['"]""",
    r"(?im)^(?:admin|root|administrator)[:\s]", r"(?i)SLEEP\(|BENCHMARK\(|WAITFOR\s+DELAY",
    r"(?i)SELECT\s+.*\s+FROM\s+information_schema", r"""(?i)OR\s+['"]?1['"]?\s*=\s*['"]?1['"]?""",
]
# Words and patterns of single attack types.
SQL_WORDS = ["sql", "union", "select", "' or", "1=1"]
ADMIN_WORDS = ["admin", "root", "administrator", "system"]
RANSOMWARE = r"(?i)vssadmin.*delete|shadowcopy.*delete|encrypt|\.locked|bcdedit"
WEBSHELL = r"(?i)\.(php|asp|aspx|jsp)\?cmd=|c99|r57|b374k|wso|eval\s*\("


def category_pattern(pattern: str) -> str:
    return pattern[5:] if pattern.startswith("(?-i)") else "(?i)" + pattern
