"""Catalogue: readers' transforms, line typing, grouping, field extraction and envelope."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracehound.functions import normalize as nz
from tracehound.operators import parsing as ps
from tracehound.operators import detect
from tracehound.plans import jobs
from tracehound.plans.catalog_entries import WITH_E, WITH_T, tagged, us
from tracehound.plans.registry import Registry, quoted
from tracehound.plans.views import (
    DOC_LINES_SQL, EVENT_IDS, EVENTS_SQL, FEEDBACK_SQL, LINES_SQL, TIMELINE_SQL, WINEVENTS_SQL, _events, doc_lines, entries,
    feedback, file_timeline, raw_lines, table, windows_events,
)
from tracehound.rules import attacks, dims
from tracehound.rules.specs import PATTERN_SPECS
from tracehound.rules.formats import CONTINUATIONS, ENTRY_OPENINGS, LINE_TESTS, RAW, TYPE_NAMES, start_anchored
from tracehound.session import shared_path
from tracehound.sources import readers, sinks

R = Registry()
YEAR = 2024
WITH_L = f"WITH {LINES_SQL}"


def _test_sql(kind: str, arg, line: str = "line") -> str:
    if kind == "re":
        return f"regexp_matches({line}, {quoted(start_anchored(arg))})"
    if kind == "find":
        return f"regexp_matches({line}, {quoted(arg)})"
    if kind == "has":
        return "(" + " OR ".join(f"contains({line}, {quoted(w)})" for w in arg) + ")"
    if kind == "json":
        return f"json_valid({line})"
    if kind == "array":
        return f"(json_valid({line}) AND coalesce(json_array_length(CASE WHEN json_valid({line}) THEN {line} END), 0) > 0)"
    if kind in ("keys", "keys_find"):
        names, extra = (arg, "") if kind == "keys" else (arg[0], f" AND regexp_matches({line}, {quoted(arg[1])})")
        keys = f"json_keys(CASE WHEN json_valid({line}) AND starts_with({line}, '{{') THEN {line} END)"
        return "(coalesce(" + " AND ".join(f"list_contains({keys}, '{k}')" for k in names) + extra + ", false))"
    header, width, at, value, absent = arg
    return (f"(starts_with({line}, {quoted(header)}) OR (len(string_split({line}, ',')) >= {width} AND string_split({line}, ',')[{at + 1}] = '{value}' "
            f"AND NOT contains({line}, '{absent}')))")


_TYPE_CASE = "CASE " + " ".join(f"WHEN {_test_sql(k, a)} THEN {quoted(n)}" for n, k, a in LINE_TESTS) + f" ELSE '{RAW}' END"
_TYPED = f"typed AS (SELECT *, {_TYPE_CASE} AS line_type FROM raw_lines)"

# --- readers' transforms --------------------------------------------------------------------------------


@R.add("a1_read_lines", """
WITH l AS (SELECT unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM documents)
SELECT count(*) AS lines, count(*) FILTER (trim(line) <> '') AS filled, sum(length(line))::BIGINT AS chars, max(length(line))::BIGINT AS longest, 0::BIGINT AS gaps FROM l""")
def a1_files(spark, d):
    """The documents as text files, read back by the reader; each file's lines are numbered from 0 without a gap."""
    path = shared_path(spark, "a1")
    table(spark, d, "documents").select(F.replace("text", F.lit("\r"), F.lit(" ")).alias("text")).write.text(path)
    per_file = readers.read_lines(spark, path, keep_blank=True).groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.trim(F.col("line")) != "").alias("filled"), F.sum(F.length("line")).alias("chars"), F.max(F.length("line")).alias("longest"),
        F.countDistinct("line_no").alias("numbers"), F.max("line_no").alias("last"),
    )
    gap = (F.col("numbers") != F.col("n")) | (F.col("last") != F.col("n") - 1)
    return per_file.agg(F.sum("n").alias("lines"), F.sum("filled").alias("filled"), F.sum("chars").alias("chars"), F.max("longest").cast("bigint").alias("longest"), F.count_if(gap).alias("gaps"))


@R.add("a1_document_lines", f"WITH {DOC_LINES_SQL} SELECT source, count(*) AS lines, count(*) FILTER (trim(line) <> '') AS filled, max(length(line))::BIGINT AS longest FROM doc_lines GROUP BY 1")
def a1(spark, d):
    return doc_lines(spark, d).groupBy("source").agg(
        F.count("*").alias("lines"), F.count_if(F.trim("line") != "").alias("filled"), F.max(F.length("line")).cast("bigint").alias("longest"))


@R.add("a2_sources_together", f"WITH {LINES_SQL}, {DOC_LINES_SQL} SELECT 'events' AS source_name, count(*) AS n FROM raw_lines UNION ALL SELECT 'documents', count(*) FROM doc_lines")
def a2(spark, d):
    return readers.source_counts(readers.tag_sources({"events": raw_lines(spark, d), "documents": doc_lines(spark, d)}))


_ARRAYS = """arrays AS (SELECT conv_id::VARCHAR AS source, CASE WHEN conv_id % 3 = 0 THEN '[[{"role":"' || role || '","turn":' || turn || '}]]'
  WHEN conv_id % 3 = 1 THEN '[{"turn":' || turn || '},{"role":"' || role || '"}]' ELSE 'plain ' || role END AS line FROM conversations)"""


@R.add("a3_json_arrays", f"""WITH {_ARRAYS}
SELECT source, 0::BIGINT AS element_no, CASE WHEN starts_with(line, '[[') THEN line[3:-3] ELSE line END AS line FROM arrays WHERE NOT starts_with(line, '[{{')
UNION ALL SELECT source, 0, split_part(line[2:-2], ',', 1) FROM arrays WHERE starts_with(line, '[{{') UNION ALL SELECT source, 1, split_part(line[2:-2], ',', 2) FROM arrays WHERE starts_with(line, '[{{')""")
def a3(spark, d):
    c = table(spark, d, "conversations")
    k = F.col("conv_id") % 3
    line = (
        F.when(k == 0, F.concat(F.lit('[[{"role":"'), "role", F.lit('","turn":'), F.col("turn").cast("string"), F.lit("}]]")))
        .when(k == 1, F.concat(F.lit('[{"turn":'), F.col("turn").cast("string"), F.lit('},{"role":"'), "role", F.lit('"}]')))
        .otherwise(F.concat(F.lit("plain "), "role"))
    )
    out = readers.explode_json_array(c.select(F.col("conv_id").cast("string").alias("source"), line.alias("line")))
    return out.withColumn("element_no", F.col("element_no").cast("bigint"))


@R.add("a4_windows_csv_rows", f"WITH {EVENTS_SQL}" + """
SELECT epoch_us(date_trunc('second', ts)) AS us, 4600 + k AS event_id, CASE WHEN k % 2 = 0 THEN 'error' ELSE 'info' END AS severity, 'u' || user_id AS account_name, '10.1.1.' || (k % 9) AS ip FROM ev WHERE event_id % 50 <> 0""")
def a4(spark, d):
    ev = _events(spark, d)
    rows = ev.select(
        F.when(F.col("event_id") % 50 == 0, "TimeCreated").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("TimeCreated"),
        (F.lit(4600) + F.col("k")).cast("string").alias("EventID"), F.when(F.col("k") % 2 == 0, "Audit Failure").otherwise("Information").alias("LevelDisplayName"),
        F.lit("Security").alias("LogName"), F.lit("pc1").alias("MachineName"), F.lit("An account, logged on").alias("Message"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("AccountName"), F.lit("3").alias("LogonType"), F.concat(F.lit("10.1.1."), (F.col("k") % 9).cast("string")).alias("IpAddress"),
    )
    return readers.windows_rows(rows).select(us().alias("us"), "event_id", "severity", "account_name", "ip")


@R.add("a5_json_lines", "SELECT event_id, event_type AS outcome, 'u' || user_id AS user, 'info' AS severity, 'json' AS log_type FROM events WHERE event_id % 7 <> 0")
def a5(spark, d):
    ev = table(spark, d, "events")
    name = F.when(F.col("event_id") % 2 == 0, "user").otherwise("username")
    key = F.when(F.col("event_id") % 2 == 0, "status").otherwise("outcome")
    line = F.when(F.col("event_id") % 7 == 0, "not json").otherwise(
        F.format_string('{"%s": "u%d", "%s": "%s", "value": %s}', name, F.col("user_id"), key, F.col("event_type"), F.col("value").cast("string")))
    return readers.parse_json_lines(ev.select("event_id", line.alias("line"))).select("event_id", "outcome", "user", "severity", "log_type")


@R.add("a6_event_xml", f"WITH {WINEVENTS_SQL} SELECT record_id, event_id, us, computer, channel, CASE WHEN event_id % 2 = 0 THEN 'Error' ELSE 'Information' END AS level, object_name FROM winev")
def a6(spark, d):
    w = windows_events(spark, d)
    xml = F.format_string(
        '<Event><System><EventID>%d</EventID><Level>%s</Level><TimeCreated SystemTime="%s"/><EventRecordID>%d</EventRecordID><Channel>%s</Channel><Computer>%s</Computer></System>'
        '<EventData><Data Name="ObjectName">%s</Data><Data Name="Empty"></Data></EventData></Event>',
        F.col("event_id"), F.when(F.col("event_id") % 2 == 0, "2").otherwise("4"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.col("record_id"),
        F.col("channel"), F.col("computer"), F.element_at("event_data", F.lit("ObjectName")))
    out = readers.parse_event_xml(w.select(xml.alias("xml")))
    return out.select("record_id", "event_id", us().alias("us"), "computer", "channel", "level", F.element_at("event_data", F.lit("ObjectName")).alias("object_name"))


@R.add("a7_file_timeline", f"WITH {TIMELINE_SQL} SELECT DISTINCT type, filename, modified, created FROM timeline WHERE filename IS NOT NULL")
def a7(spark, d):
    t = file_timeline(spark, d)
    line = F.concat_ws("\t", "type", "filename", F.concat("modified", F.lit(" (UTC)")), "accessed", "mft_modified", F.concat("created", F.lit(" (UTC)")))
    lines = t.select(F.explode(F.array(line, line, F.lit("====== banner"), F.lit("Image: disk.dd"))).alias("line"))
    return readers.parse_file_timeline(lines).select("type", "filename", "modified", "created")


@R.add("a8_usn_text", "SELECT epoch_us(l_shipdate) AS us, 'rec ' || l_orderkey || '-' || l_linenumber || ' at ' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || ' FILE_CREATE' AS raw FROM lineitem WHERE l_linenumber <> 7")
def a8(spark, d):
    li = table(spark, d, "lineitem")
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    text = F.concat(F.lit("rec "), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(" at "), stamp, F.lit(" FILE_CREATE"))
    line = F.when(F.col("l_linenumber") == 7, F.lit("No USN journal")).otherwise(text)
    return readers.parse_usn_text(li.select(line.alias("line"))).select(us().alias("us"), "raw")


@R.add("a9_event_bounds", f"WITH {WINEVENTS_SQL} SELECT channel, min(us) AS first_us, max(us) AS last_us, count(*) AS events FROM winev GROUP BY 1")
def a9(spark, d):
    return readers.event_bounds(windows_events(spark, d), "channel").select("channel", us("first_event").alias("first_us"), us("last_event").alias("last_us"), "events")


_UNSW = list(dims.FLOW_TYPES["unsw_nb15"])
_CIC = list(dims.FLOW_TYPES["cicids2017"])


def _flows(spark, d):
    ev = _events(spark, d)
    unsw = ev.select(
        F.get(F.array(*[F.lit(x) for x in _UNSW]), (F.col("event_id") % len(_UNSW)).cast("int")).alias("attack_cat"), (F.col("event_id") % 3).cast("string").alias("label"),
        F.lit("tcp").alias("proto"), F.concat(F.lit("10.2.0."), (F.col("k") % 20).cast("string")).alias("srcip"), F.col("k").cast("string").alias("sport"), F.lit("10.3.0.1").alias("dstip"),
        F.lit("80").alias("dsport"), F.col("k").cast("string").alias("dur"), F.col("event_id").cast("string").alias("sbytes"))
    cic = ev.select(
        F.get(F.array(*[F.lit(x) for x in _CIC]), (F.col("event_id") % len(_CIC)).cast("int")).alias("Label"), F.col("k").cast("string").alias("Flow Duration"),
        F.lit("3").alias("Total Fwd Packets"), F.lit("4").alias("Total Backward Packets"))
    return readers.training_set(readers.flow_samples(unsw, "unsw_nb15"), readers.flow_samples(cic, "cicids2017"))


_FLOW_SQL = f"WITH {EVENTS_SQL}, m1(c, i, t) AS (VALUES " + ", ".join(f"({quoted(k)}, {i}, {quoted(v)})" for i, (k, v) in enumerate(dims.FLOW_TYPES["unsw_nb15"].items())) + "), m2(c, i, t) AS (VALUES " + ", ".join(
    f"({quoted(k)}, {i}, {quoted(v)})" for i, (k, v) in enumerate(dims.FLOW_TYPES["cicids2017"].items())) + f"""),
flows AS (SELECT 'unsw_nb15' AS dataset, c AS attack_category, t AS attack_type, 'warning' AS severity, 'tcp flow from 10.2.0.' || (k % 20) || ':' || k || ' to 10.3.0.1:80 dur=' || k || '.00s bytes=' || event_id AS message
  FROM ev JOIN m1 ON i = event_id % {len(_UNSW)} WHERE event_id % 3 <> 0 AND c <> 'Normal'
 UNION ALL SELECT 'cicids2017', c, t, CASE WHEN contains(c, 'DDoS') THEN 'critical' ELSE 'warning' END, 'Flow duration=' || k || ' packets=3 fwd 4 bwd' FROM ev JOIN m2 ON i = event_id % {len(_CIC)} WHERE c <> 'BENIGN')"""


@R.add("a10_flow_samples", _FLOW_SQL + " SELECT dataset, attack_category, attack_type, severity, message FROM flows")
def a10(spark, d):
    return _flows(spark, d).select("dataset", "attack_category", "attack_type", "severity", "message")


@R.add("a10_flow_type_counts", _FLOW_SQL + " SELECT attack_type, count(*) AS n FROM flows GROUP BY 1")
def a10b(spark, d):
    return readers.type_counts(_flows(spark, d))


@R.add("a11_export_entries", WITH_T + " SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, log_type, severity, ip AS source_ip, usr AS user, coalesce(action, '') AS action, outcome, message, attack_type FROM t WHERE is_anomaly")
def a11(spark, d):
    e = tagged(spark, d)
    return sinks.export_frame(e, e.where("is_anomaly").select("id"), "csv")


@R.add("a13_feedback", f"WITH {FEEDBACK_SQL} SELECT entry_id, user_label, original_prediction FROM fb WHERE user_label IN ('safe', 'unsafe', 'attack_pattern')")
def a13(spark, d):
    return sinks.valid_feedback(feedback(spark, d)).select("entry_id", "user_label", "original_prediction")


# --- typing and grouping --------------------------------------------------------------------------------


@R.add("b1_line_type", WITH_L + f", {_TYPED} SELECT source, line_no, line_type FROM typed")
def b1(spark, d):
    return ps.line_type(raw_lines(spark, d)).select("source", "line_no", "line_type")


@R.add("b1_line_type_documents", f"WITH {DOC_LINES_SQL} SELECT line_type, count(*) AS n FROM (SELECT {_TYPE_CASE} AS line_type FROM (SELECT trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS line FROM doc_lines)) GROUP BY 1")
def b1b(spark, d):
    return ps.line_type(doc_lines(spark, d)).groupBy("line_type").agg(F.count("*").alias("n"))


_MATCH = "list_filter([" + ", ".join(f"CASE WHEN {_test_sql(k, a)} THEN {quoted(n)} END" for n, k, a in LINE_TESTS) + "], lambda x: x IS NOT NULL)"
_PRIO = "(VALUES " + ", ".join(f"({quoted(n)}, {i})" for i, n in enumerate([*TYPE_NAMES, RAW])) + ")"


@R.add("b2_source_type", WITH_L + f""",
head AS (SELECT source, rn, {_MATCH} AS types FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_no) AS rn FROM raw_lines) WHERE rn <= 100),
ev1 AS (SELECT source, unnest(types) AS type, 3 AS votes FROM head WHERE rn <= 10),
cand AS (SELECT source, list(DISTINCT type) AS cands FROM ev1 GROUP BY 1),
late AS (SELECT h.source, coalesce(list_filter(types, lambda x: c.cands IS NULL OR list_contains(c.cands, x))[1], '{RAW}') AS type FROM head h LEFT JOIN cand c USING (source) WHERE rn > 10),
sc AS (SELECT source, type, sum(votes) AS score FROM (SELECT * FROM ev1 UNION ALL SELECT source, type, CASE WHEN type = '{RAW}' THEN 1 ELSE 3 END FROM late) GROUP BY 1, 2),
pr(type, p) AS {_PRIO}
SELECT source, CASE WHEN score >= 3 THEN type ELSE '{RAW}' END AS source_type, score::BIGINT AS score FROM sc JOIN pr USING (type) QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, p) = 1""")
def b2(spark, d):
    return ps.detect_source_type(raw_lines(spark, d), 100, 10)


_FORCED = next(p for types, p, *_ in PATTERN_SPECS if types == ["NGINX"])


@R.add("b3_forced_type", WITH_L + f""", {_TYPED} SELECT source, line_no, line_type AS own_type, 'NGINX' AS line_type,
 CASE WHEN regexp_matches(line, {quoted(_FORCED)}) THEN regexp_extract(line, {quoted(_FORCED)}, 1) END AS f_ip, CASE WHEN regexp_matches(line, {quoted(_FORCED)}) THEN regexp_extract(line, {quoted(_FORCED)}, 5) END AS f_status FROM typed""")
def b3(spark, d):
    """Lines of every type read as one; only those that its pattern takes, among them lines of other types, get its fields."""
    own = ps.line_type(raw_lines(spark, d)).select("source", "line_no", F.col("line_type").alias("own_type"))
    forced = ps.parse(raw_lines(spark, d), YEAR, force_type="NGINX")
    return forced.join(own, ["source", "line_no"]).select("source", "line_no", "own_type", "line_type", *[F.when(F.col("parsed"), c).alias(n) for n, c in zip(("f_ip", "f_status"), (F.element_at("fields", F.lit("ip")), F.element_at("fields", F.lit("status"))))])


_OPEN = "(" + " OR ".join(f"regexp_matches(line, {quoted(p)})" for p in ENTRY_OPENINGS) + ")"
_STITCH = f"""m AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank FROM src), p AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY source ORDER BY line_no), true) AS ab FROM m),
g AS (SELECT *, max(CASE WHEN NOT blank AND ({_OPEN} OR ab) THEN line_no END) OVER (PARTITION BY source ORDER BY line_no) AS opener FROM p)
SELECT source, opener AS line_no, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS entry FROM g WHERE NOT blank GROUP BY 1, 2"""


@R.add("b4_group_entries", f"WITH {DOC_LINES_SQL}, src AS (SELECT * FROM doc_lines), {_STITCH}")
def b4(spark, d):
    return ps.group_entries(doc_lines(spark, d), 50)


def _stitched(spark, d):
    """Every third line of a source opens an entry with a time stamp, the others follow it."""
    c = table(spark, d, "conversations")
    stamp = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("2024-01-01 00:00:0"), (F.col("turn") % 10).cast("string"), F.lit(" "))).when(F.col("turn") % 3 == 1, F.lit("    at ")).otherwise(F.lit("Caused by: "))
    return c.select(F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("line_no"), F.concat(stamp, F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"))


@R.add("b4_group_conversations", f"""WITH src AS (SELECT conv_id::VARCHAR AS source, turn AS line_no,
  CASE WHEN turn % 3 = 0 THEN '2024-01-01 00:00:0' || (turn % 10) || ' ' WHEN turn % 3 = 1 THEN '    at ' ELSE 'Caused by: ' END || replace(text, chr(10), ' ') AS line FROM conversations), {_STITCH}""")
def b4b(spark, d):
    return ps.group_entries(_stitched(spark, d), 4)


def _slow(spark, d):
    """Slow-query log over the event stream: four lines per event, and a stray comment after every ninth."""
    ev = _events(spark, d)
    lines = F.array(
        F.concat(F.lit("# Time: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("# User@Host: u"), F.col("user_id").cast("string"), F.lit("[app] @ db"), (F.col("k") % 5).cast("string"), F.lit(" [10.0.0."), (F.col("k") % 9).cast("string"), F.lit("]")),
        F.concat(F.lit("# Query_time: "), F.col("k").cast("string"), F.lit(".5 Rows_examined: "), F.col("event_id").cast("string")),
        F.concat(F.lit("SELECT * FROM t"), F.col("k").cast("string"), F.lit(";")),
        F.when(F.col("event_id") % 9 == 0, "# administrator command").otherwise("WHERE 1"),
        F.lit("UPDATE x SET y = 1;"),
    )
    return ev.select(F.concat(F.lit("slow"), (F.col("user_id") % 4).cast("string")).alias("source"), (F.col("event_id") * 10).alias("at"), F.posexplode(lines).alias("i", "line")).select(
        "source", (F.col("at") + F.col("i")).alias("line_no"), "line")


_SLOW = EVENTS_SQL + """, blocks AS (SELECT 'slow' || (user_id % 4) AS source, event_id * 10 AS line_no, *, event_id % 9 = 0 AS stray FROM ev)"""


@R.add("b5_group_blocks", f"WITH {_SLOW} SELECT source, line_no, CASE WHEN stray THEN 4 ELSE 6 END::BIGINT AS n_lines FROM blocks")
def b5(spark, d):
    return ps.group_blocks(_slow(spark, d), "mysql_slow", 1000).select("source", "line_no", "n_lines")


@R.add("b6_parse_blocks", f"""WITH {_SLOW} SELECT source, line_no, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'u' || user_id AS user, 'db' || (k % 5) AS host, '10.0.0.' || (k % 9) AS ip, k + 0.5::DOUBLE AS query_time,
  event_id AS rows_examined, 'SELECT * FROM t' || k || CASE WHEN stray THEN '' ELSE ' UPDATE x SET y = 1' END AS sql FROM blocks""")
def b6(spark, d):
    return ps.parse_blocks(ps.group_blocks(_slow(spark, d), "mysql_slow", 1000), "mysql_slow").drop("severity")


def _fields(df, names):
    return [F.element_at("fields", F.lit(n)).alias(f"f_{n}") for n in names]


@R.add("b7_extract_fields", WITH_L + f""", {_TYPED},
x AS (SELECT source, line_no, line_type, line,
 CASE line_type WHEN 'Linux SSHD Failed' THEN regexp_extract(line, 'user (\\S+) from', 1) WHEN 'Linux SSHD Accepted' THEN regexp_extract(line, 'for (\\S+) from', 1) WHEN 'NGINX' THEN nullif(regexp_extract(line, '^\\S+ - (\\S+)', 1), '-')
   WHEN 'Postfix' THEN regexp_extract(line, 'sasl_username=(\\S+)', 1) END AS f_user,
 CASE WHEN line_type IN ('Linux SSHD Failed', 'Linux SSHD Accepted') THEN regexp_extract(line, 'from (\\S+) port', 1) WHEN line_type IN ('Apache', 'NGINX') THEN regexp_extract(line, '^(\\S+)', 1) END AS f_ip,
 CASE WHEN line_type IN ('iptables') THEN regexp_extract(line, 'SRC=(\\S+)', 1) WHEN line_type = 'FortiGate' THEN regexp_extract(line, 'srcip=(\\S+)', 1) WHEN line_type = 'Windows Firewall' THEN string_split(line, ' ')[5] END AS f_src_ip,
 CASE WHEN line_type IN ('Apache', 'NGINX') THEN regexp_extract(line, '" (\\d+) ', 1) WHEN line_type = 'VSFTPD' THEN 'ok' END AS f_status,
 CASE WHEN line_type = 'iptables' THEN 'drop' WHEN line_type = 'FortiGate' THEN 'deny' WHEN line_type = 'Windows Firewall' THEN 'allow' WHEN line_type = 'VSFTPD' THEN 'login' WHEN line_type = 'Postfix' THEN 'connect' END AS f_action
 FROM typed)
SELECT source, line_no, f_user, f_ip, f_src_ip, f_status, f_action FROM x""")
def b7(spark, d):
    df = ps.extract_fields(ps.line_type(raw_lines(spark, d)))
    return df.select("source", "line_no", *_fields(df, ["user", "ip", "src_ip", "status", "action"]))


_IP = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"


def _ex(pattern: str, group: int = 1, line: str = "line") -> str:
    return f"nullif(regexp_extract({line}, {quoted(pattern)}, {group}), '')"


def _pair(key: str) -> str:
    """SQL of the first pair with a key, in order of the operator's patterns; pairs go before the patterns of single values."""
    found = [f"list_filter(list_zip(regexp_extract_all(line, {quoted(p)}, 1), regexp_extract_all(line, {quoted(p)}, 2)), lambda x: lower(x[1]) = '{key}')" for (p,) in ps.PAIR_PATTERNS]
    return f"list_concat({', '.join(found)})[1][2]"


@R.add("b8_generic_fields", WITH_L + f" SELECT source, line_no, coalesce({_pair('src_ip')}, {_ex('(?i)SRC[=_]' + _IP)}, {_ex('(?i)from' + chr(92) + 's+' + _IP)}) AS f_src_any, coalesce({_pair('ip')}, {_ex(_IP)}) AS f_ip FROM raw_lines")
def b8(spark, d):
    df = ps.generic_fields(raw_lines(spark, d))
    return df.select("source", "line_no", F.element_at("fields", F.lit("src_ip")).alias("f_src_any"), F.element_at("fields", F.lit("ip")).alias("f_ip"))


@R.add("b8_generic_fields_whole", WITH_L + f"""
SELECT source, line_no, coalesce({_pair('src_ip')}, {_ex('(?i)SRC[=_]' + _IP)}, {_ex('(?i)from' + chr(92) + 's+' + _IP)}) AS f_src_any, coalesce({_pair('ip')}, {_ex(_IP)}) AS f_ip, {_pair('srcip')} AS f_srcip, {_pair('action')} AS f_action FROM raw_lines""")
def b8_whole(spark, d):
    df = ps.generic_fields(raw_lines(spark, d))
    return df.select("source", "line_no", F.element_at("fields", F.lit("src_ip")).alias("f_src_any"), *_fields(df, ["ip", "srcip", "action"]))


def _dyn(name: str) -> str:
    return "coalesce(" + ", ".join(_ex(p) for p in ps.DYNAMIC[name]) + ")"


@R.add("b9_dynamic_fields", WITH_L + f"""
SELECT source, line_no, {_dyn('timestamp')} AS dyn_timestamp, {_dyn('ip')} AS dyn_ip, {_dyn('port')} AS dyn_port,
 CASE WHEN lower({_dyn('severity')}) IN ('debug', 'info', 'warning', 'error', 'critical') THEN lower({_dyn('severity')}) ELSE 'unknown' END AS severity FROM raw_lines""")
def b9(spark, d):
    return ps.dynamic_fields(raw_lines(spark, d)).select("source", "line_no", "dyn_timestamp", "dyn_ip", "dyn_port", "severity")


@R.add("b10_infer_structure", f"WITH {LINES_SQL}" + r""",
h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_no) AS rn FROM raw_lines QUALIFY rn <= 50),
c AS (SELECT source, sum(len(regexp_extract_all(line, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}')))::BIGINT AS ip_hits, sum(len(regexp_extract_all(line, '(?i)user[=:]\s*[''"]?(\w+)')))::BIGINT AS user_hits FROM h GROUP BY 1),
f AS (SELECT source, line, CASE WHEN len(string_split(line, ',')) >= 3 THEN ',' WHEN len(string_split(line, chr(9))) >= 3 THEN chr(9) WHEN len(string_split(line, ' | ')) >= 3 THEN ' | ' WHEN len(string_split(line, ' ')) >= 3 THEN ' ' ELSE 'unknown' END AS separator,
  contains(line, '=') AS has_key_pairs FROM h WHERE rn = 1)
SELECT source, separator, CASE separator WHEN 'unknown' THEN 0 ELSE len(string_split(line, separator)) END::BIGINT AS n_columns, has_key_pairs, ip_hits, user_hits, CASE WHEN ip_hits > 2 THEN round(least(ip_hits / 50, 1), 6)::DOUBLE END AS ip_confidence FROM f JOIN c USING (source)""")
def b10(spark, d):
    return ps.infer_structure(raw_lines(spark, d), 50).select("source", "separator", F.size("columns").cast("bigint").alias("n_columns"), "has_key_pairs", "ip_hits", "user_hits", F.round("ip_confidence", 6).alias("ip_confidence"))


@R.add("b11_timestamps", WITH_L + f""",
t AS (SELECT source, line_no, coalesce(try_strptime({_ex(r'(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})')}, '%Y-%m-%dT%H:%M:%S'), try_strptime({_ex(r'(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})')}, '%d/%b/%Y:%H:%M:%S'),
  try_strptime('{YEAR} ' || {_ex(r'(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})')}, '%Y %b %d %H:%M:%S'), try_strptime({_ex(r'(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})')}, '%Y-%m-%d %H:%M:%S')) AS ts FROM raw_lines)
SELECT source, line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM t""")
def b11(spark, d):
    none = F.create_map(F.lit("x"), F.lit("y"))
    return raw_lines(spark, d).select("source", "line_no", F.date_format(nz.line_ts(F.col("line"), none, YEAR), "yyyy-MM-dd HH:mm:ss").alias("ts"))


def _any(words: list[str], text: str = "low") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_SEVERITY = (f"CASE WHEN {_any(['critical', 'fatal', 'crit'])} THEN 'critical' WHEN {_any(['err', 'fail', 'denied', 'reject'])} THEN 'error' WHEN {_any(['warn', 'alert'])} THEN 'warning' "
             f"WHEN {_any(['debug', 'trace'])} THEN 'debug' ELSE 'info' END")


@R.add("b12_severity", WITH_L + f" SELECT source, line_no, {_SEVERITY} AS severity FROM (SELECT *, lower(line) AS low FROM raw_lines)")
def b12(spark, d):
    return raw_lines(spark, d).select("source", "line_no", nz.severity_col(F.col("line")).alias("severity"))


def _no_fields():
    return F.create_map(F.lit("none"), F.lit(None).cast("string"))


@R.add("b13_source", WITH_L + f"""
SELECT source, line_no, coalesce({_ex('(?i)from' + chr(92) + 's+' + _IP)}, {_ex('(?i)SRC=' + _IP)}, {_ex('(?i)srcip=' + _IP)}, {_ex('(?i)src_ip=' + _IP)}, {_ex(_IP)}) AS ip,
  TRY_CAST(coalesce({_ex(r'(?i)port\s+(\d+)')}, {_ex(r'(?i)DPT=(\d+)')}, {_ex(r'(?i)dstport=(\d+)')}) AS VARCHAR) AS port FROM raw_lines""")
def b13(spark, d):
    s = nz.source_struct(F.col("line"), _no_fields())
    return raw_lines(spark, d).select("source", "line_no", s["ip"].alias("ip"), s["port"].cast("string").alias("port"))


@R.add("b14_user", WITH_L + f" SELECT source, line_no, coalesce({_ex(r'(?i)for\s+(\S+)\s+from')}, {_ex(r'(?i)user[=:\s]+(\w+)')}, {_ex(r'(?i)User:\s*(\S+)')}) AS user FROM raw_lines")
def b14(spark, d):
    return raw_lines(spark, d).select("source", "line_no", nz.user_name_col(F.col("line"), _no_fields()).alias("user"))


@R.add("b15_normalize_user", "SELECT event_id, 'u' || user_id AS name, CASE event_id % 3 WHEN 0 THEN 'corp' WHEN 1 THEN 'example.com' END AS domain FROM events")
def b15(spark, d):
    ev = table(spark, d, "events")
    u = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("CORP\\"), u)).when(F.col("event_id") % 3 == 1, F.concat(u, F.lit("@Example.com"))).otherwise(F.concat(F.lit(" "), u))
    return ev.select("event_id", nz.normalize_user(text).alias("n")).select("event_id", "n.name", "n.domain")


@R.add("b16_action", WITH_L + f" SELECT source, line_no, CASE WHEN {_any(['accepted', 'success', 'allow'])} THEN 'allow' WHEN {_any(['failed', 'denied', 'reject', 'drop'])} THEN 'deny' WHEN {_any(['connect', 'login'])} THEN 'connect' WHEN {_any(['disconnect', 'logout'])} THEN 'disconnect' ELSE 'unknown' END AS action FROM (SELECT *, lower(line) AS low FROM raw_lines)")
def b16(spark, d):
    return raw_lines(spark, d).select("source", "line_no", nz.action_col(F.col("line"), _no_fields()).alias("action"))


@R.add("b17_outcome", WITH_E + f""" SELECT id, CASE WHEN f_status = '200' THEN 'success' WHEN f_status = '500' THEN 'failure' WHEN {_any(['accepted', 'success', 'allowed', 'completed'])} THEN 'success'
 WHEN {_any(['failed', 'denied', 'reject', 'error', 'deny', 'drop'])} THEN 'failure' ELSE 'unknown' END AS outcome FROM (SELECT *, lower(message) AS low FROM entries)""")
def b17(spark, d):
    return entries(spark, d).select("id", nz.outcome_col(F.col("message"), F.col("fields")).alias("outcome"))


@R.add("b18_status_severity", "SELECT event_id, CASE WHEN s >= 400 THEN 'failure' WHEN s BETWEEN 200 AND 299 THEN 'success' END AS outcome, CASE WHEN s >= 500 THEN 'critical' WHEN s >= 400 THEN 'warning' ELSE 'info' END AS severity FROM (SELECT event_id, 200 + event_id % 350 AS s FROM events)")
def b18(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", nz.status_severity((F.lit(200) + F.col("event_id") % 350).cast("string")).alias("s")).select("event_id", "s.outcome", "s.severity")


@R.add("b19_tags", WITH_E + f""" SELECT id, array_to_string(list_filter([log_type, CASE WHEN {_any(['error', 'fail', 'critical'])} THEN 'error' END, CASE WHEN {_any(['warning', 'warn'])} THEN 'warning' END,
 CASE WHEN {_any(['auth', 'login', 'password', 'ssh'])} THEN 'auth' END, CASE WHEN {_any(['attack', 'injection', 'exploit'])} THEN 'security' END], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT *, lower(message) AS low FROM entries)""")
def b19(spark, d):
    return entries(spark, d).select("id", F.array_join(nz.tags_col(F.col("log_type"), F.col("message")), ",").alias("tags"))


_LT = "CASE line_type " + " ".join(f"WHEN {quoted(k)} THEN '{v}'" for k, v in dims.LOG_TYPE_OF.items()) + " ELSE 'raw' END"
_LS = "CASE " + " ".join(f"WHEN log_type IN ({', '.join(quoted(t) for t in ts)}) THEN '{s}'" for s, ts in dims.LOG_SOURCES.items()) + " ELSE 'other' END"
_CT = "CASE " + " ".join(f"WHEN regexp_matches(log_type, {quoted(p)}) THEN '{c}'" for c, p in dims.CATEGORY_PATTERNS) + " ELSE 'generic' END"


@R.add("b20_type_dims", WITH_L + f", {_TYPED}, lt AS (SELECT source, line_no, {_LT} AS log_type FROM typed) SELECT source, line_no, log_type, {_LS} AS log_source, {_CT} AS category FROM lt")
def b20(spark, d):
    return ps.type_dims(ps.line_type(raw_lines(spark, d))).select("source", "line_no", "log_type", "log_source", "category")


@R.add("b21_firewall_verdict", f"""WITH {EVENTS_SQL} SELECT event_id, '10.0.0.' || (k % 7) AS src_ip, '10.9.9.' || (k % 5) AS dst_ip, CASE WHEN k % 2 = 0 THEN 'blocked' ELSE 'allowed' END AS outcome,
 CASE WHEN k % 2 = 0 THEN 'firewall_block' ELSE 'firewall_allow' END AS action, CASE WHEN k % 2 = 0 THEN 'warning' ELSE 'info' END AS severity FROM ev""")
def b21(spark, d):
    ev = _events(spark, d)
    line = F.format_string("kernel: %s IN=eth0 SRC=10.0.0.%d DST=10.9.9.%d PROTO=TCP", F.when(F.col("k") % 2 == 0, "DROP").otherwise("ACCEPT"), F.col("k") % 7, F.col("k") % 5)
    return ev.select("event_id", nz.firewall_verdict(line).alias("v")).select("event_id", "v.*")


@R.add("b22_winevent_action", f"WITH {WINEVENTS_SQL} SELECT record_id, CASE WHEN channel = 'Security' THEN CASE event_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in dims.EVENT_ACTIONS.items())
       + f" ELSE 'event' END ELSE 'event' END AS action, CASE WHEN event_id IN ({', '.join(map(str, dims.EVENT_FAILURES))}) THEN 'failure' ELSE 'success' END AS outcome FROM winev")
def b22(spark, d):
    return ps.winevent_action(windows_events(spark, d)).select("record_id", "action", "outcome")


# lines of the last two formats have no spec, and some stray formats are typed otherwise than they are spelled
@R.add("b23_parse_stats", WITH_L + f", {_TYPED}, s AS (SELECT count(*) AS t, count(*) FILTER (line_type <> '{RAW}') AS p FROM typed) SELECT t AS total_lines, p AS parsed_lines, t - p AS failed_lines, round(100.0::DOUBLE * p / t) AS success_rate FROM s")
def b23(spark, d):
    return ps.parse_stats(ps.parse(raw_lines(spark, d), YEAR))


@R.add("b24_merge_chunks", f"""WITH {EVENTS_SQL}, c AS (SELECT user_id % 11 AS chunk, count(*) AS total_lines, count(*) FILTER (event_type = 'error') AS failed_lines FROM ev GROUP BY 1)
SELECT sum(total_lines) FILTER (chunk <> 3)::BIGINT AS total_lines, sum(failed_lines) FILTER (chunk <> 3)::BIGINT AS failed_lines, round(sum(total_lines - failed_lines) FILTER (chunk <> 3) * 100.0::DOUBLE / sum(total_lines) FILTER (chunk <> 3), 2) AS success_rate,
  count(*) FILTER (chunk <> 3) AS ok_chunks, count(*) FILTER (chunk = 3) AS failed_chunks FROM c""")
def b24(spark, d):
    ev = _events(spark, d)
    c = ev.groupBy((F.col("user_id") % 11).alias("chunk")).agg(F.count("*").alias("total_lines"), F.count_if(F.col("event_type") == "error").alias("failed_lines"))
    return ps.merge_chunk_stats(c.withColumn("ok", F.col("chunk") != 3))


_GEO = """geo AS (SELECT (20 + 8 * n_nationkey)::BIGINT * 16777216 AS lo, (20 + 8 * n_nationkey + 6)::BIGINT * 16777216 + 8388607 AS hi, 'C' || n_nationkey AS country FROM nation),
hosts AS (SELECT DISTINCT (10 + user_id % 230) || '.' || (event_id % 256) || '.1.7' AS ip, (10 + user_id % 230) AS a, event_id % 256 AS b FROM events)"""


@R.add("b25_country", f"WITH {_GEO} SELECT ip, CASE WHEN a = 10 THEN 'LOCAL' WHEN a = 172 AND b = 16 THEN 'LOCAL' WHEN a = 192 AND b = 168 THEN 'LOCAL' ELSE coalesce(country, '??') END AS country FROM hosts LEFT JOIN geo ON a::BIGINT * 16777216 + b * 65536 + 263 BETWEEN lo AND hi")
def b25(spark, d):
    n = table(spark, d, "nation")
    lo = (F.lit(20) + F.col("n_nationkey") * 8).cast("bigint")
    geo = n.select((lo * 16777216).alias("lo"), ((lo + 6) * 16777216 + 8388607).alias("hi"), F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country"))
    hosts = table(spark, d, "events").select(F.concat_ws(".", (F.col("user_id") % 230 + 10).cast("string"), (F.col("event_id") % 256).cast("string"), F.lit("1"), F.lit("7")).alias("ip")).distinct()
    return ps.enrich_country(hosts, geo)


@R.add("b26_entry_ids", WITH_L + " SELECT sha256(source || ':' || line_no || ':' || line) AS id, line_no FROM raw_lines")
def b26(spark, d):
    return raw_lines(spark, d).select(nz.entry_id(F.col("source"), F.col("line_no"), F.col("line")).alias("id"), "line_no")


@R.add("b27_to_entries", WITH_L + f", {_TYPED}, lt AS (SELECT *, lower(line) AS low, {_LT} AS log_type FROM typed) SELECT sha256(source || ':' || line_no || ':' || line) AS id, line_no, log_type, {_LS} AS log_source, {_SEVERITY} AS severity, line AS message FROM lt")
def b27(spark, d):
    e = ps.to_entries(ps.parse(raw_lines(spark, d), YEAR))
    return e.select("id", "line_no", "log_type", "log_source", "severity", "message")


@R.add("b27_parse_tag_alert")
def b27b(spark, d):
    """Whole path from lines to alerts: parse, tag, detect."""
    cfg = detect.DetectionConfig(bruteforce_n=3, bruteforce_minutes=7 * 24 * 60, spray_n=3, spray_minutes=24 * 60)
    return jobs.parse_job(raw_lines(spark, d), YEAR, cfg)["alerts"].groupBy("type").agg(F.count("*").alias("alerts"))
