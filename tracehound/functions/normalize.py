"""Envelope columns of an entry, taken from the raw line and the extracted fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracehound.functions import prefilter as pre
from tracehound.rules import dims

IPV4 = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"

# Layouts of a timestamp in a line, with the Spark layout that reads it.
LINE_TIMES = [
    (r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}{tail})", "iso"),
    (r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})(?: ([+-]\d{4}))?", "dd/MMM/yyyy:HH:mm:ss"),
    (r"(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})", "yyyy MMM d HH:mm:ss"),
    (r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}{tail})", "iso"),
]
# A fraction of a second and an offset, where a time has them.
TAIL = r"(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2}(?!\d))?"
WHOLE_TIMES = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss", "yyyy MMM d HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS",
]


def found(text: Column, pattern: str, group: int = 1, low: Column | None = None) -> Column:
    """The group of the first match, null where the pattern or the group does not match.

    With ``low``, the text in lower case, the pattern runs only where the text holds the plain strings of every match.
    """
    value = F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    blind, clauses = pre.needed(pattern)
    if low is None or not clauses:
        return value
    return F.when(reduce(lambda a, b: a & b, [has_any(low if blind else text, sorted(c)) for c in clauses]), value)


def bind(value: Column, use) -> Column:
    """Evaluate a column once and hand it to an expression that needs it several times."""
    return F.transform(F.array(value), use)[0]


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def field(fields: Column, *keys: str) -> Column:
    """First of the keys that holds a value."""
    return F.coalesce(*[F.element_at(fields, F.lit(k)) for k in keys])


def _squeeze(col: Column) -> Column:
    return F.regexp_replace(col, r"\s+", " ")


def normalize_ts(text: Column, default_year: int) -> Column:
    """A timestamp given alone, in any of the known layouts; year-less ones get the default year."""
    t = F.trim(text)
    tries = []
    for layout in WHOLE_TIMES:
        value = F.concat(F.lit(f"{default_year} "), _squeeze(t)) if layout.startswith("yyyy MMM") else t
        tries.append(F.try_to_timestamp(value, F.lit(layout)))
    return F.coalesce(*tries)


def iso_ts(text: Column) -> Column:
    """A year-first time with its fraction and offset; without an offset it is in the session's zone."""
    plain = F.replace(_squeeze(text), F.lit(","), F.lit("."))
    return F.regexp_replace(plain, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")


def line_ts(line: Column, fields: Column, default_year: int, ingest: Column | None = None) -> Column:
    """Parsed timestamp field, else the first layout found in the line, else the ingest time."""
    tries = [iso_ts(found(field(fields, "timestamp"), rf"^(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}{TAIL})"))]
    for pattern, layout in LINE_TIMES:
        pattern = pattern.replace("{tail}", TAIL)
        value = found(line, pattern, 1, line)  # no layout ignores case
        if layout == "iso":
            tries.append(iso_ts(value))
            continue
        if layout.startswith("yyyy MMM"):
            value = F.concat(F.lit(f"{default_year} "), _squeeze(value))
        elif layout.startswith("dd/"):
            # null without both parts: a text that does not parse costs an exception
            zoned = F.concat(value, F.lit(" "), found(line, pattern, 2, line))
            tries.append(F.try_to_timestamp(zoned, F.lit(layout + " xx")))
        tries.append(F.try_to_timestamp(value, F.lit(layout)))
    if ingest is not None:
        tries.append(ingest)
    return F.coalesce(*tries)


def severity_col(line: Column, low: Column | None = None) -> Column:
    low = F.lower(line) if low is None else low
    return (
        F.when(has_any(low, ["critical", "fatal", "crit"]), "critical")
        .when(has_any(low, ["error", "err", "fail", "failed", "denied", "reject"]), "error")
        .when(has_any(low, ["warning", "warn", "alert"]), "warning")
        .when(has_any(low, ["debug", "trace"]), "debug")
        .otherwise("info")
    )


def source_ip_col(line: Column, fields: Column, low: Column | None = None) -> Column:
    return F.coalesce(
        field(fields, "client_ip", "src_ip", "source_ip", "ip", "server_ip"),
        found(line, r"(?i)from\s+" + IPV4, 1, low),
        found(line, r"(?i)SRC=" + IPV4, 1, low),
        found(line, r"(?i)srcip=" + IPV4, 1, low),
        found(line, r"(?i)src_ip=" + IPV4, 1, low),
        found(line, IPV4, 1, low),
    )


def source_port_col(line: Column, low: Column | None = None) -> Column:
    return F.coalesce(
        found(line, r"(?i)port\s+(\d+)", 1, low), found(line, r"(?i)DPT=(\d+)", 1, low), found(line, r"(?i)dstport=(\d+)", 1, low)
    ).try_cast("int")


def source_struct(line: Column, fields: Column, low: Column | None = None) -> Column:
    return F.struct(
        source_ip_col(line, fields, low).alias("ip"),
        source_port_col(line, low).alias("port"),
        field(fields, "host", "hostname").alias("hostname"),
        field(fields, "service").alias("service"),
        field(fields, "pid").try_cast("int").alias("pid"),
    )


def destination_struct(fields: Column) -> Column:
    return F.struct(
        field(fields, "dst_ip", "dest_ip").alias("ip"),
        field(fields, "dst_port", "dest_port").try_cast("int").alias("port"),
        field(fields, "dst_host").alias("hostname"),
    )


def user_name_col(line: Column, fields: Column, low: Column | None = None) -> Column:
    return F.coalesce(
        field(fields, "user"),
        found(line, r"(?i)for\s+(\S+)\s+from", 1, low),
        found(line, r"(?i)user[=:\s]+(\w+)", 1, low),
        found(line, r"(?i)User:\s*(\S+)", 1, low),
        found(line, r"(?i)server_principal_name=([^=,\s]+)", 1, low),
    )


def normalize_user(col: Column) -> Column:
    """``DOM\\user``, ``user@dom`` or ``user`` -> struct of lower-cased name and domain."""
    text = F.lower(F.trim(col))
    slash, at = F.instr(text, "\\"), F.instr(text, "@")
    name = F.when(slash > 0, text.substr(slash + 1, F.length(text))).when(
        at > 0, text.substr(F.lit(1), at - 1)
    ).otherwise(text)
    domain = F.when(slash > 0, text.substr(F.lit(1), slash - 1)).when(at > 0, text.substr(at + 1, F.length(text)))
    return F.struct(F.nullif(name, F.lit("")).alias("name"), domain.alias("domain"))


def action_col(line: Column, fields: Column, low: Column | None = None) -> Column:
    low = F.lower(line) if low is None else low
    verb = F.lower(F.nullif(F.element_at(F.split(F.trim(field(fields, "request")), r"\s+"), 1), F.lit("")))
    return F.coalesce(
        field(fields, "action"),
        verb,
        F.when(has_any(low, ["accepted", "success", "allow"]), "allow")
        .when(has_any(low, ["failed", "denied", "reject", "drop"]), "deny")
        .when(has_any(low, ["connect", "login"]), "connect")
        .when(has_any(low, ["disconnect", "logout"]), "disconnect")
        .otherwise("unknown"),
    )


def outcome_col(line: Column, fields: Column, low: Column | None = None) -> Column:
    low = F.lower(line) if low is None else low
    status = field(fields, "status").try_cast("int")
    return F.coalesce(
        field(fields, "outcome"),
        F.when(status.between(200, 299), "success").when(status >= 400, "failure"),
        F.when(has_any(low, ["accepted", "success", "allowed", "completed"]), "success")
        .when(has_any(low, ["failed", "denied", "reject", "error", "deny", "drop"]), "failure")
        .otherwise("unknown"),
    )


def status_severity(status: Column) -> Column:
    """HTTP status -> struct of outcome and severity."""
    code = status.try_cast("int")
    return F.struct(
        F.when(code >= 400, "failure").when(code.between(200, 299), "success").alias("outcome"),
        F.when(code >= 500, "critical").when(code >= 400, "warning").otherwise("info").alias("severity"),
    )


def tags_col(log_type: Column, line: Column, low: Column | None = None) -> Column:
    low = F.lower(line) if low is None else low
    return F.array_compact(
        F.array(
            log_type,
            F.when(has_any(low, ["error", "fail", "critical"]), "error"),
            F.when(has_any(low, ["warning", "warn"]), "warning"),
            F.when(has_any(low, ["auth", "login", "password", "ssh"]), "auth"),
            F.when(has_any(low, ["attack", "injection", "exploit"]), "security"),
        )
    )


# Tags of a log type, first matching name part wins.
TYPE_TAGS = [
    (["ssh_auth"], "auth,ssh,security"), (["mysql"], "database,mysql"), (["postgres"], "database,postgresql"),
    (["oracle"], "database,oracle"), (["sqlserver"], "database,sqlserver"), (["mongodb"], "database,mongodb"),
    (["iptables", "ufw"], "firewall,linux,network"), (["windows_firewall"], "firewall,windows,network"),
    (["apache", "nginx"], "webserver,http,access"), (["postfix", "sendmail"], "mail,smtp,email"),
    (["syslog", "systemd"], "system,linux"), (["kernel"], "system,linux,kernel"),
    (["audit"], "system,linux,audit,security"),
]


def type_tags_col(log_type: Column) -> Column:
    """Tags that follow from the log type alone."""
    low = F.lower(log_type)
    out = None
    for parts, tags in TYPE_TAGS:
        cond = has_any(low, parts)
        value = F.lit(tags)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return F.split(F.coalesce(out, F.lit("")), ",")


def _map_of(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def log_type_of(line_type: Column) -> Column:
    return F.coalesce(F.element_at(_map_of(dims.LOG_TYPE_OF), line_type), F.lit("raw"))


def log_source_of(log_type: Column) -> Column:
    pairs = {t: s for s, types in dims.LOG_SOURCES.items() for t in types}
    return F.coalesce(F.element_at(_map_of(pairs), log_type), F.lit("other"))


def category_of(log_type: Column) -> Column:
    low = F.lower(log_type)
    out = None
    for name, pattern in dims.CATEGORY_PATTERNS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("generic")


def firewall_verdict(line: Column) -> Column:
    """SRC/DST pair of a firewall line with its verdict; null where the line has none."""
    pair = r"SRC=(\d{1,3}(?:\.\d{1,3}){3})\s+DST=(\d{1,3}(?:\.\d{1,3}){3})"
    blocked = has_any(line, ["DROP", "BLOCK"])
    return F.when(
        line.rlike(pair),
        F.struct(
            F.regexp_extract(line, pair, 1).alias("src_ip"),
            F.regexp_extract(line, pair, 2).alias("dst_ip"),
            F.when(blocked, "blocked").otherwise("allowed").alias("outcome"),
            F.when(blocked, "firewall_block").otherwise("firewall_allow").alias("action"),
            F.when(blocked, "warning").otherwise("info").alias("severity"),
        ),
    )


def ip_number(ip: Column) -> Column:
    """IPv4 text as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    octets = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def is_local_ip(ip: Column) -> Column:
    return (
        ip.isNull() | (ip == "") | ip.isin("127.0.0.1", "localhost", "::1") | ip.startswith("192.168.")
        | ip.startswith("10.") | ip.startswith("172.16.")
    )


def entry_id(source: Column, line_no: Column, line: Column) -> Column:
    return F.sha2(F.concat_ws(":", source, line_no.cast("string"), line), 256)
