"""Views that turn the plain tables into entries, raw lines, file records, journals and event logs.

Each view exists twice, as a DataFrame and as SQL text, from the same templates, so that a query and its
SQL twin start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# message of an entry, by event_id % 8; the fifth one is clean
MESSAGES = [
    "Failed password for invalid user {user} from {ip} port {port} ssh2",
    "GET /item.php?id=1' OR '1'='1 UNION SELECT name FROM information_schema.tables HTTP/1.1",
    "GET /search?q=<script>alert(document.cookie)</script> HTTP/1.1 referer=javascript:void",
    "GET /static/../../etc/passwd HTTP/1.1 404 host blacklist hit",
    "Accepted publickey for {user} from {ip} port {port} ssh2",
    "authentication failure; sudo su - root user={user} connection refused",
    "vssadmin.exe delete shadows /all and encrypt user files to {user}.locked",
    "POST /upload/c99.php?cmd=id; cat /etc/hosts | bash -i [SPAM] scan",
]

# raw line of an event, by type number
LINES = [
    "{sys} web01 sshd[{pid}]: Failed password for invalid user {user} from {ip} port {port} ssh2",
    "{sys} web01 sshd[{pid}]: Accepted password for {user} from {ip} port {port} ssh2",
    '{ip} - - [{clf}] "GET /shop/item?id={k} HTTP/1.1" {status} {bytes}',
    '{ip} - {user} [{clf}] "POST /api/v1/login HTTP/1.1" {status} {bytes}',
    "{sys} fw kernel: IPTABLES-DROP: IN=eth0 OUT= MAC=aa:bb SRC={ip} DST=10.9.9.9 LEN=40 PROTO=TCP SPT={port} DPT=22",
    "{iso} ALLOW TCP {ip} 10.9.9.9 {port} 443",
    "{isot}.000Z {pid} [ERROR] [MY-{code}] [Server] Access denied for user {user}",
    "{iso}.000 UTC [{pid}] {user}@shop ERROR: relation k{k} does not exist",
    "{sys} mail postfix/smtpd[{pid}]: connect from mx{k}[{ip}] sasl_username={user}",
    '{sys} ftp-prod vsftpd[{pid}]: [{user}] OK LOGIN: Client "{ip}"',
    "date={day} time={time} action=deny srcip={ip} dstip=10.9.9.9 service=HTTP",
    "user={user} action=view status {status} src_ip={ip} elapsed: {k}ms",
    "{iso} ERROR Security {code} User: {user} Logon failed",
    "critical: disk {k} of {user} is full",
]

TOKEN = re.compile(r"\{(\w+)\}")


def _spark_text(template: str, cols: dict[str, Column]) -> Column:
    parts = []
    for i, piece in enumerate(TOKEN.split(template)):
        if piece:
            parts.append(cols[piece] if i % 2 else F.lit(piece))
    return F.concat(*parts)


def _sql_text(template: str, cols: dict[str, str]) -> str:
    parts = []
    for i, piece in enumerate(TOKEN.split(template)):
        if piece:
            parts.append(cols[piece] if i % 2 else "'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def _pick(selector: Column, values: list[Column]) -> Column:
    out = F.when(selector == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        out = out.when(selector == i, value)
    return out


def _sql_pick(selector: str, values: list[str]) -> str:
    return f"CASE {selector} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


LOG_TYPES = ["nginx", "mysql_error", "ssh_auth", "syslog", "iptables"]
SOURCES = ["web", "database", "auth", "system", "firewall"]
OUTCOME = {"error": "failure", "signup": "success"}
ACTION = {"error": "deny", "signup": "allow", "click": "sudo", "view": "login", "purchase": "deliver"}


#: Session setting: number of tasks over which the views deal a table that is one file with one row group. Unset, files are read as they are.
TASKS = "spark.tracehound.view.tasks"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    tasks = int(spark.conf.get(TASKS, "0"))
    return rows.repartition(tasks) if tasks else rows


def _events(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _address() -> Column:
    """One of eighty addresses by user and event; some users roam and have a new one for each event."""
    event = F.col("event_id")
    part = lambda by, of: (F.floor(event / by) % of).cast("string")
    roaming = F.concat_ws(".", F.lit("10"), (100 + F.floor(event / 40_000) % 150).cast("string"), part(200, 200), part(1, 200))
    return F.when(F.col("user_id") % 17 == 3, roaming).otherwise(F.concat_ws(".", F.lit("10.0"), (F.col("user_id") % 20).cast("string"), (event % 4).cast("string")))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Entry table over the event stream."""
    ev = _events(spark, d)
    cols = {
        "user": F.concat(F.lit("u"), F.col("user_id").cast("string")),
        "ip": _address(),
        "port": (F.lit(1000) + F.col("k")).cast("string"),
    }
    kind = F.col("event_id") % 5
    return ev.select(
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"),
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source_name"),
        F.col("event_id").alias("line_no"),
        "ts",
        _pick(kind, [F.lit(x) for x in LOG_TYPES]).alias("log_type"),
        _pick(kind, [F.lit(x) for x in SOURCES]).alias("log_source"),
        F.when(F.col("value") < 10, "debug").when(F.col("value") < 40, "info").when(F.col("value") < 90, "warning")
        .when(F.col("value") < 170, "error").otherwise("critical").alias("severity"),
        F.struct(
            cols["ip"].alias("ip"), (F.lit(1000) + F.col("k")).alias("port"),
            F.concat(F.lit("srv"), (F.col("user_id") % 5).cast("string")).alias("hostname"),
            F.lit(None).cast("string").alias("service"), F.lit(None).cast("int").alias("pid"),
        ).alias("source"),
        F.struct(
            F.lit(None).cast("string").alias("ip"), F.lit(None).cast("int").alias("port"),
            F.concat(F.lit("h"), (F.col("event_id") % 7).cast("string")).alias("hostname"),
        ).alias("destination"),
        F.struct(cols["user"].alias("name"), F.lit(None).cast("string").alias("domain")).alias("user"),
        F.coalesce(*[F.when(F.col("event_type") == t, a) for t, a in ACTION.items()]).alias("action"),
        F.coalesce(*[F.when(F.col("event_type") == t, o) for t, o in OUTCOME.items()], F.lit("unknown")).alias("outcome"),
        _pick(F.col("event_id") % 8, [_spark_text(m, cols) for m in MESSAGES]).alias("message"),
        _pick(F.col("event_id") % 8, [_spark_text(m, cols) for m in MESSAGES]).alias("raw_line"),
        F.when(
            kind == 0,
            F.create_map(F.lit("status"), F.when(F.col("event_type") == "error", "500").otherwise("200"),
                         F.lit("bytes"), F.floor(F.col("value") * 100).cast("string")),
        ).otherwise(F.create_map(F.lit("k"), F.col("k").cast("string"))).alias("fields"),
        F.when(F.col("event_id") % 10 == 9, F.array(_pick(kind, [F.lit(x) for x in LOG_TYPES])))
        .otherwise(F.array(_pick(kind, [F.lit(x) for x in LOG_TYPES]), F.lit("auth"))).alias("tags"),
        (F.col("value") > 150).alias("is_anomaly"),
        F.round(F.least(F.col("value") / 500, F.lit(1.0)), 6).alias("anomaly_score"),
    )


_SQL_COLS = {
    "user": "'u' || user_id", "port": "(1000 + k)::VARCHAR",
    "ip": "CASE WHEN user_id % 17 = 3 THEN '10.' || (100 + event_id // 40000 % 150) || '.' || (event_id // 200 % 200) || '.' || (event_id % 200) ELSE '10.0.' || (user_id % 20) || '.' || (event_id % 4) END",
}
_SQL_COLS["ip"] = f"({_SQL_COLS['ip']})"
#: Addresses of the raw lines; all their users stay at one.
_LINE_IP = "'10.0.' || (user_id % 20) || '.' || (event_id % 4)"

EVENTS_SQL = """ev AS (
  SELECT event_id, user_id, event_type, value, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""

ENTRIES_SQL = EVENTS_SQL + f""",
entries AS (
  SELECT 'e' || lpad(event_id::VARCHAR, 12, '0') AS id, 's' || (user_id % 3) AS source_name, event_id AS line_no, ts,
    epoch_us(ts) AS us,
    {_sql_pick('event_id % 5', [repr(x) for x in LOG_TYPES])} AS log_type,
    {_sql_pick('event_id % 5', [repr(x) for x in SOURCES])} AS log_source,
    CASE WHEN value < 10 THEN 'debug' WHEN value < 40 THEN 'info' WHEN value < 90 THEN 'warning'
         WHEN value < 170 THEN 'error' ELSE 'critical' END AS severity,
    {_SQL_COLS['ip']} AS ip, 1000 + k AS port, 'srv' || (user_id % 5) AS src_host, 'h' || (event_id % 7) AS dst_host,
    {_SQL_COLS['user']} AS usr,
    CASE event_type {' '.join(f"WHEN '{t}' THEN '{a}'" for t, a in ACTION.items())} END AS action,
    CASE event_type {' '.join(f"WHEN '{t}' THEN '{o}'" for t, o in OUTCOME.items())} ELSE 'unknown' END AS outcome,
    {_sql_pick('event_id % 8', [_sql_text(m, _SQL_COLS) for m in MESSAGES])} AS message,
    CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_type = 'error' THEN '500' ELSE '200' END END AS f_status,
    CASE WHEN event_id % 5 = 0 THEN floor(value * 100)::BIGINT::VARCHAR END AS f_bytes,
    CASE WHEN event_id % 5 <> 0 THEN k::VARCHAR END AS f_k,
    (event_id % 10 <> 9 OR event_id % 5 = 2) AS is_auth,
    value > 150 AS is_anomaly, round(least(value / 500, 1.0), 6) AS anomaly_score
  FROM ev)"""


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """Log lines of fourteen formats, twelve sources, each with one main format and some stray lines."""
    ev = _events(spark, d)
    fmt = lambda layout: F.date_format("ts", layout)
    cols = {
        "sys": fmt("MMM dd HH:mm:ss"), "iso": fmt("yyyy-MM-dd HH:mm:ss"), "isot": fmt("yyyy-MM-dd'T'HH:mm:ss"),
        "clf": fmt("dd/MMM/yyyy:HH:mm:ss"), "day": fmt("yyyy-MM-dd"), "time": fmt("HH:mm:ss"),
        "user": F.concat(F.lit("u"), F.col("user_id").cast("string")),
        "ip": F.concat_ws(".", F.lit("10.0"), (F.col("user_id") % 20).cast("string"), (F.col("event_id") % 4).cast("string")),
        "port": (F.lit(1000) + F.col("k")).cast("string"), "k": F.col("k").cast("string"),
        "pid": (F.col("event_id") % 9000 + 1000).cast("string"), "code": (F.col("k") + 1000).cast("string"),
        "status": F.when(F.col("event_type") == "error", "500").when(F.col("event_type") == "click", "404").otherwise("200"),
        "bytes": F.floor(F.col("value") * 100).cast("string"),
    }
    n = len(LINES)
    kind = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % n).otherwise(F.col("user_id") % 12)
    return ev.select(
        F.concat(F.lit("host"), (F.col("user_id") % 12).cast("string")).alias("source"),
        F.col("event_id").alias("line_no"),
        _pick(kind, [_spark_text(t, cols) for t in LINES]).alias("line"),
    )


_LINE_COLS = {
    "sys": "strftime(ts, '%b %d %H:%M:%S')", "iso": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
    "isot": "strftime(ts, '%Y-%m-%dT%H:%M:%S')", "clf": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
    "day": "strftime(ts, '%Y-%m-%d')", "time": "strftime(ts, '%H:%M:%S')",
    "user": "'u' || user_id", "ip": _LINE_IP, "port": "(1000 + k)::VARCHAR", "k": "k::VARCHAR",
    "pid": "(event_id % 9000 + 1000)::VARCHAR", "code": "(k + 1000)::VARCHAR",
    "status": "CASE event_type WHEN 'error' THEN '500' WHEN 'click' THEN '404' ELSE '200' END",
    "bytes": "floor(value * 100)::BIGINT::VARCHAR",
}
_LINE_COLS = {k: f"({v})" for k, v in _LINE_COLS.items()}

LINES_SQL = EVENTS_SQL + f""",
raw_lines AS (
  SELECT 'host' || (user_id % 12) AS source, event_id AS line_no,
    {_sql_pick(f"CASE WHEN event_id % 5 = 0 THEN event_id % {len(LINES)} ELSE user_id % 12 END", [_sql_text(t, _LINE_COLS) for t in LINES])} AS line
  FROM ev)"""


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document, with its place."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("source"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


DOC_LINES_SQL = """doc_lines AS (
  SELECT doc_id::VARCHAR AS source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents)"""

FN_CREATED_SHIFT = [0, 3600, 86400, 1, 3456000, 604800, 30]
FN_MODIFIED_SHIFT = [0, 7200, 0, 31536000, 2]
EXTENSIONS = [".exe", ".docx", ".log", ".dll"]
FOLDERS = ["\\users\\u{m}\\", "\\windows\\system32\\", "\\program files\\app{m}\\", "\\users\\u{m}\\temp\\", "\\data\\d{m}\\"]


def file_name(key: Column) -> Column:
    return F.concat(F.lit("file"), key.cast("string"), _pick(key % 4, [F.lit(x) for x in EXTENSIONS]))


def file_path(key: Column) -> Column:
    cols = {"m": (key % 37).cast("string")}
    return F.concat(F.lit("c:"), _pick(key % 5, [_spark_text(t, cols) for t in FOLDERS]), file_name(key))


def _sql_name(key: str) -> str:
    return f"('file' || {key} || {_sql_pick(f'({key}) % 4', [repr(x) for x in EXTENSIONS])})"


def _sql_path(key: str) -> str:
    cols = {"m": f"(({key}) % 37)"}
    return f"('c:' || {_sql_pick(f'({key}) % 5', [_sql_text(t, cols) for t in FOLDERS])} || {_sql_name(key)})"


def _shift(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("bigint") * 1_000_000)


def file_records(spark: SparkSession, d: str) -> DataFrame:
    """File records: created at the order date, modified at the first shipment, $FN times shifted."""
    ship = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").cast("timestamp").alias("first_ship"), F.max("l_shipdate").cast("timestamp").alias("last_ship")
    )
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("record_no"), "o_custkey", F.col("o_orderdate").cast("timestamp").alias("si_created"))
    key = F.col("record_no")
    shift = lambda sel, values: _pick(sel, [F.lit(v) for v in values])
    return o.join(ship, F.col("record_no") == F.col("l_orderkey")).select(
        (key % 3).cast("int").alias("partition"), "record_no", (F.col("o_custkey") % 30).cast("int").alias("sequence_no"),
        (key % 11 != 0).alias("in_use"), F.lit(False).alias("is_dir"), file_path(key).alias("filename"),
        "si_created", F.col("first_ship").alias("si_modified"), F.col("last_ship").alias("si_accessed"),
        F.col("last_ship").alias("si_mft_modified"),
        _shift(F.col("si_created"), shift(key % 7, FN_CREATED_SHIFT)).alias("fn_created"),
        _shift(F.col("first_ship"), shift(key % 5, FN_MODIFIED_SHIFT)).alias("fn_modified"),
        F.col("last_ship").alias("fn_accessed"), F.col("last_ship").alias("fn_mft_modified"),
    )


FILES_SQL = f"""files AS (
  SELECT (o_orderkey % 3)::INTEGER AS partition, o_orderkey AS record_no, (o_custkey % 30)::INTEGER AS sequence_no,
    {_sql_path('o_orderkey')} AS filename, epoch_us(o_orderdate) AS si_c, epoch_us(fs) AS si_m, epoch_us(ls) AS si_a,
    epoch_us(o_orderdate) + 1000000::BIGINT * {_sql_pick('o_orderkey % 7', [str(v) for v in FN_CREATED_SHIFT])} AS fn_c,
    epoch_us(fs) + 1000000::BIGINT * {_sql_pick('o_orderkey % 5', [str(v) for v in FN_MODIFIED_SHIFT])} AS fn_m
  FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) fs, max(l_shipdate) ls FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def journal(spark: SparkSession, d: str) -> DataFrame:
    """Change-journal records, one per line item."""
    li = table(spark, d, "lineitem")
    reason = (
        F.when(F.col("l_returnflag") == "N", F.lit(0x100)).when(F.col("l_returnflag") == "R", F.lit(0x3))
        .otherwise(F.lit(0x80002000)).cast("bigint")
        + F.when(F.col("l_linestatus") == "F", F.lit(0x10)).otherwise(F.lit(0)).cast("bigint")
    )
    return li.select(
        (F.col("l_orderkey") % 3).cast("int").alias("partition"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("usn"),
        F.col("l_orderkey").alias("file_ref"), F.col("l_suppkey").alias("parent_ref"),
        _shift(F.col("l_shipdate").cast("timestamp"), F.col("l_linenumber") * 3600).alias("ts"),
        reason.alias("reason"),
        # some files were only ever written under another name
        F.when(F.col("l_orderkey") % 41 == 0, F.concat(F.lit("part"), F.col("l_orderkey").cast("string"), F.lit(".tmp"))).otherwise(file_name(F.col("l_orderkey"))).alias("file_name"),
    )


JOURNAL_SQL = f"""usn AS (
  SELECT (l_orderkey % 3)::INTEGER AS partition, l_orderkey * 10 + l_linenumber AS usn, l_orderkey AS file_ref,
    epoch_us(l_shipdate) + l_linenumber::BIGINT * 3600000000 AS us,
    CASE l_returnflag WHEN 'N' THEN 256::BIGINT WHEN 'R' THEN 3 ELSE 2147491840 END
      + CASE l_linestatus WHEN 'F' THEN 16 ELSE 0 END AS reason, CASE WHEN l_orderkey % 41 = 0 THEN 'part' || l_orderkey || '.tmp' ELSE {_sql_name('l_orderkey')} END AS file_name FROM lineitem)"""


def transaction_log(spark: SparkSession, d: str) -> DataFrame:
    """Transaction-log records, one per line item; the file reference carries a sequence in its high bits."""
    li = table(spark, d, "lineitem")
    code = (F.col("l_suppkey") % 37).cast("int")
    return li.select(
        (F.col("l_orderkey") % 3).cast("int").alias("partition"),
        (F.col("l_orderkey") * 4000000 + F.col("l_linenumber") * 500000 + F.col("l_partkey")).alias("lsn"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_partkey").alias("tx_id"), code.alias("op_code"),
        F.when(code == 9, "UpdateResidentValue").when(code == 10, "UpdateNonResidentValue").otherwise("Other").alias("op_type"),
        (F.col("l_orderkey") + F.shiftleft(F.col("l_linenumber").cast("bigint"), 48)).alias("file_ref"),
        F.when(code == 6, "Rename").otherwise("").alias("details"),
    )


LSN_SQL = """lsn AS (
  SELECT (l_orderkey % 3)::INTEGER AS partition, l_orderkey * 4000000 + l_linenumber * 500000 + l_partkey AS lsn, epoch_us(l_shipdate) AS us,
    l_partkey AS tx_id, (l_suppkey % 37)::INTEGER AS op_code, l_orderkey + l_linenumber::BIGINT * 281474976710656 AS file_ref
  FROM lineitem)"""


def file_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Text timeline: file type, path and four times, some of them odd."""
    f = file_records(spark, d)
    key = F.col("record_no")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    created = (
        F.when(key % 97 == 0, F.lit("2035-05-05 05:05:05")).when(key % 89 == 0, F.lit("1601-01-01 00:00:00"))
        .when(key % 83 == 0, F.lit("1985-03-03 03:03:03")).otherwise(fmt("si_created"))
    )
    return f.select(
        F.when(key % 13 == 0, "r/r *").otherwise("r/r").alias("type"),
        F.replace(F.expr("substring(filename, 4)"), F.lit("\\"), F.lit("/")).alias("filename"),
        fmt("si_modified").alias("modified"), fmt("si_accessed").alias("accessed"),
        fmt("si_mft_modified").alias("mft_modified"), created.alias("created"),
    )


TIMELINE_SQL = FILES_SQL + """,
timeline AS (
  SELECT CASE WHEN record_no % 13 = 0 THEN 'r/r *' ELSE 'r/r' END AS type,
    replace(substr(filename, 4), chr(92), '/') AS filename,
    strftime(make_timestamp(si_m), '%Y-%m-%d %H:%M:%S') AS modified, strftime(make_timestamp(si_a), '%Y-%m-%d %H:%M:%S') AS accessed,
    CASE WHEN record_no % 97 = 0 THEN '2035-05-05 05:05:05' WHEN record_no % 89 = 0 THEN '1601-01-01 00:00:00'
         WHEN record_no % 83 = 0 THEN '1985-03-03 03:03:03' ELSE strftime(make_timestamp(si_c), '%Y-%m-%d %H:%M:%S') END AS created
  FROM files)"""

EVENT_IDS = [4624, 4625, 4656, 4663, 4688, 4697, 4616, 1, 5140, 4634, 4672, 5145]


def windows_events(spark: SparkSession, d: str) -> DataFrame:
    """Event log over the event stream; object paths point at files of the file table."""
    ev = _events(spark, d)
    key = (F.col("event_id") * 7) % table(spark, d, "orders").agg(F.count("*").alias("n")).scalar()
    return ev.select(
        F.col("event_id").alias("record_id"),
        _pick(F.col("event_id") % 12, [F.lit(i) for i in EVENT_IDS]).alias("event_id"),
        # now and then the clock is a day behind
        F.when(F.col("event_id") % 50 == 0, _shift(F.col("ts"), F.lit(-86400))).otherwise(F.col("ts")).alias("ts"), F.concat(F.lit("pc"), (F.col("user_id") % 5).cast("string")).alias("computer"),
        F.when(F.col("event_id") % 2 == 0, "Security").otherwise("System").alias("channel"),
        F.lit("Information").alias("level"),
        F.create_map(F.lit("ObjectName"), file_path(key), F.lit("SubjectUserName"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("event_data"),
    )


WINEVENTS_SQL = EVENTS_SQL + f""",
winev AS (
  SELECT event_id AS record_id, {_sql_pick('event_id % 12', [str(i) for i in EVENT_IDS])} AS event_id, epoch_us(ts) - CASE WHEN event_id % 50 = 0 THEN 86400000000 ELSE 0 END AS us,
    'pc' || (user_id % 5) AS computer, CASE WHEN event_id % 2 = 0 THEN 'Security' ELSE 'System' END AS channel,
    {_sql_path('((event_id * 7) % (SELECT count(*) FROM orders))')} AS object_name
  FROM ev)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Volume snapshots: one per year of orders, taken at the year's last order."""
    o = table(spark, d, "orders")
    return o.groupBy(F.year("o_orderdate").alias("snapshot_id")).agg(F.max("o_orderdate").cast("timestamp").alias("taken_at"))


def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """Paths found in each snapshot."""
    li = table(spark, d, "lineitem").where("l_orderkey % 4 <> 0")
    return li.select(
        F.year("l_shipdate").alias("snapshot_id"), file_path(F.col("l_orderkey")).alias("path")
    ).distinct()


SNAPSHOTS_SQL = f"""snaps AS (SELECT year(o_orderdate) AS snapshot_id, epoch_us(max(o_orderdate)) AS us FROM orders GROUP BY 1),
snap_files AS (SELECT DISTINCT year(l_shipdate) AS snapshot_id, {_sql_path('l_orderkey')} AS path FROM lineitem WHERE l_orderkey % 4 <> 0)"""


def prefetch(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("FILE"), (F.col("p_partkey") * 8).cast("string"), F.lit("-0A"), F.col("p_size").cast("string"), F.lit(".pf")).alias("name"))


PREFETCH_SQL = "pf AS (SELECT 'FILE' || (p_partkey * 8) || '-0A' || p_size || '.pf' AS name FROM part)"


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """User feedback over the entries, every third event."""
    e = entries(spark, d).where("line_no % 3 = 0")
    label = F.when(F.col("line_no") % 2 == 0, "safe").when(F.col("line_no") % 7 == 0, "bogus").otherwise("unsafe")
    return e.select(
        F.col("id").alias("entry_id"), F.col("user.name").alias("user_id"), F.col("ts").alias("timestamp"),
        F.when(F.col("line_no") % 4 < 2, "normal").otherwise("bruteforce").alias("original_prediction"),
        label.alias("user_label"), F.lit(0.8).alias("confidence"), F.col("message").alias("log_message"),
        F.col("source.ip").alias("source_ip"), "log_type",
        F.array().cast("array<string>").alias("mitre_tactics"), F.array().cast("array<string>").alias("mitre_techniques"),
        F.create_map(F.lit("corrected_attack_type"), F.lit("sql_injection")).alias("feedback_metadata"),
    )


FEEDBACK_SQL = ENTRIES_SQL + """,
fb AS (SELECT id AS entry_id, ts, us, message, ip, log_type, CASE WHEN line_no % 4 < 2 THEN 'normal' ELSE 'bruteforce' END AS original_prediction,
   CASE WHEN line_no % 2 = 0 THEN 'safe' WHEN line_no % 7 = 0 THEN 'bogus' ELSE 'unsafe' END AS user_label FROM entries WHERE line_no % 3 = 0)"""
