"""Catalogue: filters, joins, aggregates, windows, features, alerts and chains over the entry table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracehound.functions import features, scalars
from tracehound.operators import correlate, detect, query, stats, windows
from tracehound.plans.registry import Registry, quoted
from tracehound.plans.views import ENTRIES_SQL, FEEDBACK_SQL, entries, feedback, table
from tracehound.rules import attacks, dims
from tracehound.schema import MINUTE, SECOND, micros
from tracehound.session import cut_lineage

R = Registry()
DAY_MINUTES = 24 * 60
WEEK_MINUTES = 7 * DAY_MINUTES
DAY_US, WEEK_US = DAY_MINUTES * MINUTE, WEEK_MINUTES * MINUTE


def us(col: str = "ts"):
    return micros(col)


def tagged(spark, d):
    return detect.tag_keywords(entries(spark, d))


def _keyword_case(value) -> str:
    out = "CASE "
    for name, weight, patterns in sorted(attacks.KEYWORD_RULES, key=lambda r: -r[1]):
        out += f"WHEN regexp_matches(message, {quoted(detect.any_of(patterns))}) THEN {value(name, weight)} "
    return out


WITH_E = f"WITH {ENTRIES_SQL}"
WITH_T = WITH_E + f""",
t AS (SELECT * REPLACE (CASE WHEN attack_type = 'safe' THEN severity ELSE 'warning' END AS severity) FROM (
  SELECT *, {_keyword_case(lambda n, w: quoted(n))} ELSE 'safe' END AS attack_type,
    {_keyword_case(lambda n, w: f"CAST({w} AS DOUBLE)")} ELSE CAST(0.0 AS DOUBLE) END AS attack_confidence FROM entries))"""

# --- filters and projections ----------------------------------------------------------------------------


@R.add("c1_search", WITH_T + """
SELECT id, severity, attack_type FROM t
WHERE (contains(lower(message), 'passw') OR contains(ip, 'passw') OR contains(lower(usr), 'passw')) AND attack_type = 'bruteforce'""")
def c1(spark, d):
    return query.search(tagged(spark, d), "passw", "bruteforce").select("id", "severity", "attack_type")


@R.add("c2_filter_criteria", WITH_E + """
SELECT id, log_type, ip FROM entries WHERE severity = 'warning' AND contains(lower(log_type), 'ssh') AND starts_with(lower(ip), '10.0.1') AND port > 1050""")
def c2(spark, d):
    return query.filter_criteria(entries(spark, d), [
        {"severity": "warning"}, {"log_type": "SSH"}, {"column": "source.ip", "operator": "startsWith", "value": "10.0.1"},
        {"column": "source.port", "operator": "greaterThan", "value": 1050},
    ]).select("id", "log_type", F.col("source.ip").alias("ip"))


@R.add("c3_query_entries", WITH_E + """
SELECT id, us, severity FROM entries WHERE log_type = 'nginx' ORDER BY ts DESC, id LIMIT 50""")
def c3(spark, d):
    e = query.query_entries(entries(spark, d), [{"column": "log_type", "value": "nginx"}], 50)
    return e.select("id", us().alias("us"), "severity")


@R.add("c3_query_counts", WITH_E + """
SELECT count(*) AS total_count, count(*) FILTER (severity = 'critical' AND lower(outcome) = 'failure') AS filtered_count FROM entries""")
def c3b(spark, d):
    return query.query_counts(entries(spark, d), [{"severity": "critical"}, {"column": "outcome", "value": "failure"}])


@R.add("c4_select_view", WITH_T + """
SELECT id, attack_type AS type, severity FROM t WHERE attack_type <> 'safe' AND severity = 'warning'""")
def c4(spark, d):
    e = tagged(spark, d)
    views = {"entries": e, "alerts": detect.entry_alerts(e), "stats": stats.count_by(e)}
    return query.select_view(views, "alerts", severity="warning").select("id", "type", "severity")


@R.add("c5_field_names", WITH_E + """
SELECT DISTINCT key FROM (SELECT unnest(['status', 'bytes', 'k']) AS key, unnest([f_status, f_bytes, f_k]) AS v FROM entries) WHERE v IS NOT NULL AND v <> ''""")
def c5(spark, d):
    return query.field_names(entries(spark, d))


@R.add("c5_flatten_fields", WITH_E + """
SELECT id, coalesce(f_bytes, '-') AS fields_bytes, coalesce(f_k, '-') AS fields_k, coalesce(f_status, '-') AS fields_status FROM entries""")
def c5b(spark, d):
    return query.flatten_fields(entries(spark, d), ["bytes", "k", "status"]).select("id", "fields_bytes", "fields_k", "fields_status")


@R.add("c6_attacks_only", WITH_T + "SELECT id, attack_type, attack_confidence FROM t WHERE attack_type NOT IN ('safe', 'normal')")
def c6(spark, d):
    return query.attacks_only(tagged(spark, d)).select("id", "attack_type", "attack_confidence")


@R.add("c7_recent_feedback", f"WITH {FEEDBACK_SQL} SELECT entry_id, user_label FROM fb WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR")
def c7(spark, d):
    now = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return query.recent_feedback(feedback(spark, d), now).select("entry_id", "user_label")


# --- joins ----------------------------------------------------------------------------------------------

_SQLI = " OR ".join(f"contains(lower(message), {quoted(w)})" for w in attacks.SQL_WORDS)


@R.add("d1_web_then_database", WITH_E + f""",
w AS (SELECT id, us FROM entries WHERE log_source = 'web' AND ({_SQLI})),
p AS (SELECT w.id, w.us, b.us AS next_us, b.id AS next_id FROM w JOIN entries b ON b.log_source = 'database' AND b.us > w.us AND b.us < w.us + {600 * SECOND})
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY next_us, next_id) = 1""")
def d1(spark, d):
    return correlate.sqli_pairs(correlate.slim(entries(spark, d)), 600).select("id", "us", "next_us", "next_id")


_SAF = WITH_E + f""",
f AS (SELECT usr, us, ip FROM entries WHERE outcome = 'failure' AND is_auth), s AS (SELECT id, usr, us FROM entries WHERE outcome = 'success' AND is_auth)"""


@R.add("d2_failures_before_success", _SAF + f"""
SELECT s.id, s.usr AS user, s.us, count(*) AS failures FROM s JOIN f ON s.usr = f.usr AND f.us < s.us AND f.us >= s.us - {WEEK_US} GROUP BY ALL HAVING count(*) >= 1""")
def d2(spark, d):
    return windows.success_after_failures(entries(spark, d), 1, WEEK_MINUTES)


@R.add("d3_attach_predictions", WITH_T + """
SELECT e.id, e.outcome, p.attack_type FROM entries e LEFT JOIN (SELECT id, attack_type FROM t WHERE attack_type <> 'safe') p USING (id)""")
def d3(spark, d):
    p = query.attacks_only(tagged(spark, d)).select("id", "attack_type")
    return entries(spark, d).select("id", "outcome").join(p, "id", "left")


@R.add("d7_anomalies_without_alert", WITH_T + "SELECT id, ip AS source_ip FROM t WHERE is_anomaly AND attack_type = 'safe'")
def d7(spark, d):
    e = tagged(spark, d)
    return detect.anomaly_alerts(e, detect.entry_alerts(e)).select("id", "source_ip")


_IPCHAIN = """ipc AS (
  SELECT ip, count(*) AS events, count(*) FILTER (attack_type <> 'safe') AS tags, count(*) FILTER (is_anomaly) AS anomalies,
    min(attack_type) FILTER (attack_type <> 'safe') AS first_type, count(DISTINCT attack_type) FILTER (attack_type <> 'safe') AS n_types,
    count(DISTINCT log_type) AS services, min(us) AS start_us, max(us) AS end_us FROM t WHERE ip <> 'LOCAL' GROUP BY ip),
ipchains AS (SELECT ip, coalesce(first_type, 'behavioral_outlier') AS attack_type, CASE WHEN n_types > 1 THEN 'execution' ELSE 'reconnaissance' END AS stage,
    events, services, round(0.75 + least(events, 10) * 0.02, 6) AS confidence, start_us, end_us FROM ipc
  WHERE tags >= 2 OR anomalies >= 2 OR (tags >= 1 AND anomalies >= 1))"""


@R.add("d8_threat_scores", WITH_T + f", {_IPCHAIN}" + """,
top AS (SELECT ip, count(*) AS n FROM entries GROUP BY ip ORDER BY n DESC, ip LIMIT 10)
SELECT top.ip, top.n, least(coalesce(c.confidence, 0.0), 1.0)::DOUBLE AS threat_score FROM top LEFT JOIN ipchains c USING (ip)""")
def d8(spark, d):
    e = tagged(spark, d)
    out = stats.threat_scores(e, correlate.ip_chains(e).select("ip", "confidence"), 10)
    return out.withColumn("threat_score", F.round("threat_score", 6))


_MITRE = "CASE attack_type " + " ".join(f"WHEN {quoted(k)} THEN {quoted(', '.join(v[0]))}" for k, v in dims.CHAIN_MITRE.items()) + f" ELSE {quoted(', '.join(dims.CHAIN_MITRE_DEFAULT[0]))} END"


@R.add("d9_mitre_lookup", WITH_T + f"SELECT id, attack_type, {_MITRE} AS tactics FROM t")
def d9(spark, d):
    return detect.add_mitre(tagged(spark, d)).select("id", "attack_type", F.array_join("mitre_tactics", ", ").alias("tactics"))


# --- aggregates -----------------------------------------------------------------------------------------


@R.add("e1_count_by", WITH_E + """
SELECT 'log_type' AS dimension, log_type AS value, count(*) AS n FROM entries GROUP BY 2
UNION ALL SELECT 'severity', severity, count(*) FROM entries GROUP BY 2 UNION ALL SELECT 'outcome', outcome, count(*) FROM entries GROUP BY 2""")
def e1(spark, d):
    return stats.count_by(entries(spark, d))


@R.add("e2_top_sources", WITH_E + "SELECT ip, count(*) AS n FROM entries GROUP BY 1 ORDER BY n DESC, ip LIMIT 10")
def e2(spark, d):
    return stats.top_sources(entries(spark, d))


@R.add("e2_top_users", WITH_E + "SELECT usr AS user, count(*) AS n FROM entries GROUP BY 1 ORDER BY n DESC, user LIMIT 10")
def e2b(spark, d):
    return stats.top_users(entries(spark, d))


@R.add("e3_minute_timeline", WITH_E + "SELECT epoch_us(date_trunc('minute', ts)) AS minute_us, count(*) AS n FROM entries GROUP BY 1")
def e3(spark, d):
    return stats.minute_timeline(entries(spark, d)).select(us("minute").alias("minute_us"), "n")


@R.add("e4_minute_status", WITH_E + """
SELECT epoch_us(date_trunc('minute', ts)) AS minute_us, count(*) FILTER (severity <> 'critical' AND NOT is_anomaly) AS normal,
  count(*) FILTER (severity <> 'critical' AND is_anomaly) AS anomaly, count(*) FILTER (severity = 'critical') AS critical
FROM entries GROUP BY 1 ORDER BY 1 DESC LIMIT 20""")
def e4(spark, d):
    return stats.minute_status(entries(spark, d), 20).select(us("minute").alias("minute_us"), "normal", "anomaly", "critical")


@R.add("e5_unique_counts", WITH_E + "SELECT count(DISTINCT ip) AS sources, count(DISTINCT usr) AS users FROM entries")
def e5(spark, d):
    return stats.unique_counts(entries(spark, d))


@R.add("e6_severity_share", WITH_E + f""",
dim AS (SELECT unnest({dims.REPORT_SEVERITIES}) AS severity), c AS (SELECT severity, count(*) AS n FROM entries GROUP BY 1)
SELECT dim.severity, coalesce(n, 0) AS n, round(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM entries), 2) AS percent FROM dim LEFT JOIN c USING (severity)""")
def e6(spark, d):
    return stats.severity_share(entries(spark, d))


@R.add("e7_attack_breakdown", WITH_T + "SELECT attack_type, count(*) AS n, round(avg(attack_confidence), 6) AS avg_confidence FROM t WHERE attack_type <> 'safe' GROUP BY 1")
def e7(spark, d):
    return stats.attack_breakdown(tagged(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))


_PROFILE = """p AS (SELECT ip, count(*) AS events, count(*) FILTER (outcome = 'failure') AS failures, count(DISTINCT usr) AS users, count(DISTINCT port) AS ports,
   count(DISTINCT coalesce(action, 'unknown')) AS actions, max(us) AS last_us, arg_max(id, (us, id)) AS last_id FROM entries GROUP BY ip)"""


@R.add("e8_ip_profile", WITH_E + f", {_PROFILE} SELECT * FROM p")
def e8(spark, d):
    return stats.ip_profile(entries(spark, d)).withColumn("last_us", us("last_ts")).drop("last_ts")


_UPROFILE = """u AS (SELECT usr AS user, ip, count(*) AS c, count(*) FILTER (outcome = 'failure') AS f, count(*) FILTER (outcome = 'success') AS s, min(us) AS a, max(us) AS b FROM entries GROUP BY 1, 2),
up AS (SELECT user, sum(c)::BIGINT AS events, sum(f)::BIGINT AS failures, sum(s)::BIGINT AS successes, count(ip) AS ips, count(*) FILTER (f > 0 AND s > 0) AS shared_ips, min(a) AS start_us, max(b) AS end_us FROM u GROUP BY user)"""


@R.add("e9_user_profile", WITH_E + f", {_UPROFILE} SELECT * FROM up")
def e9(spark, d):
    return stats.user_profile(entries(spark, d)).withColumns({"start_us": us("start_ts"), "end_us": us("end_ts")}).drop("start_ts", "end_ts")


@R.add("e10_attack_summary", WITH_T + """
SELECT *, least(total_attacks * 10 + total_anomalies * 5, 100) AS risk_score FROM (
 SELECT count(*) FILTER (attack_type <> 'safe') AS total_attacks, count(*) FILTER (is_anomaly) AS total_anomalies,
  array_to_string(list_sort(list(DISTINCT attack_type) FILTER (attack_type <> 'safe')), ',') AS attack_types, count(DISTINCT ip) FILTER (attack_type <> 'safe') AS attack_sources FROM t)""")
def e10(spark, d):
    return stats.attack_summary(tagged(spark, d)).withColumn("attack_types", F.array_join("attack_types", ","))


_F4DAY = f"""w(s) AS (SELECT min(us) FROM entries UNION ALL SELECT (SELECT min(e.us) FROM entries e WHERE e.us > w.s + {DAY_US}) FROM w WHERE w.s IS NOT NULL),
wins AS (SELECT e.us, max(w.s) AS window_us FROM (SELECT DISTINCT us FROM entries) e JOIN w ON w.s <= e.us GROUP BY e.us)"""
_WITH_W = "WITH RECURSIVE " + ENTRIES_SQL + ", " + _F4DAY
_BFCHAIN = """bfc AS (SELECT window_us, ip, usr AS user, count(*) AS failures, min(us) AS start_us, max(us) AS end_us FROM entries JOIN wins USING (us) WHERE outcome = 'failure' GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


def _bf_chains(e):
    return windows.bruteforce_chain(e, 2, DAY_MINUTES, DAY_MINUTES)


@R.add("e11_summary_basic", _WITH_W + f", {_BFCHAIN}" + """
SELECT count(*) AS total_events, count(*) FILTER (severity = 'critical') AS critical_alerts, (SELECT count(*) FROM bfc) AS chains,
  least(100, (SELECT count(*) FROM bfc) * 20 + count(*) FILTER (severity = 'critical') * 10 + count(*) FILTER (severity = 'error') * 5) AS risk_score FROM entries""")
def e11(spark, d):
    e = entries(spark, d)
    return stats.summary_basic(e, _bf_chains(e))


@R.add("e13_summary_api", WITH_T + f", {_IPCHAIN}" + """
SELECT *, least(total_chains * 15 + (SELECT count(*) FROM t WHERE attack_type <> 'safe' OR is_anomaly) * 2, 100) AS risk_score FROM (
  SELECT count(*) AS total_chains, count(*) FILTER (confidence > 0.85) AS critical_alerts FROM ipchains)""")
def e13(spark, d):
    e = tagged(spark, d)
    return stats.summary_api(correlate.ip_chains(e), correlate.suspicious_timeline(e))


@R.add("e14_risk_bands", WITH_E + """
SELECT 'ip' AS kind, ip AS name, n, CASE WHEN n > 100 THEN 'HIGH' WHEN n > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT ip, count(*) AS n FROM entries GROUP BY 1 ORDER BY n DESC, ip LIMIT 10)
UNION ALL SELECT 'user', usr, n, CASE WHEN n > 50 THEN 'CRITICAL' WHEN n > 20 THEN 'HIGH' ELSE 'MEDIUM' END FROM (SELECT usr, count(*) AS n FROM entries GROUP BY 1 ORDER BY n DESC, usr LIMIT 10)""")
def e14(spark, d):
    e = entries(spark, d)
    a = stats.risk_bands(stats.top_sources(e), "ip").select(F.lit("ip").alias("kind"), F.col("ip").alias("name"), "n", "risk")
    b = stats.risk_bands(stats.top_users(e), "user").select(F.lit("user").alias("kind"), F.col("user").alias("name"), "n", "risk")
    return a.unionByName(b)


_NOW = "2024-01-20 00:00:00"


def versions(spark, d):
    """Model versions over the labelled runs: one version per log type, the last one active."""
    g = entries(spark, d).groupBy("log_type").agg(F.count("*").alias("training_samples"), F.max("ts").alias("timestamp"))
    return g.select(F.concat(F.lit("v_"), "log_type").alias("version_id"), "timestamp", "training_samples", (F.col("log_type") == "syslog").alias("is_active"))


@R.add("e15_feedback_stats", f"WITH {FEEDBACK_SQL}" + f"""
SELECT count(*) AS total_feedback, count(*) FILTER (user_label = 'safe') AS safe_count, count(*) FILTER (user_label = 'unsafe') AS unsafe_count,
  count(*) FILTER (ts > TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR) AS recent_feedback_count, 5::BIGINT AS model_versions, 'v_syslog' AS current_version FROM fb""")
def e15(spark, d):
    return stats.feedback_stats(feedback(spark, d), versions(spark, d), F.to_timestamp(F.lit(_NOW)))


@R.add("e15_feedback_by_prediction", f"WITH {FEEDBACK_SQL} SELECT original_prediction, count(*) AS n FROM fb GROUP BY 1")
def e15b(spark, d):
    return stats.feedback_by_prediction(feedback(spark, d))


@R.add("e16_prediction_summary", WITH_T + """
SELECT *, least(attacks_detected * 10, 100) AS risk_score FROM (SELECT count(*) AS total_logs, count(*) FILTER (attack_type <> 'safe') AS attacks_detected, round(avg(attack_confidence), 6) AS avg_confidence FROM t)""")
def e16(spark, d):
    p = tagged(spark, d).select((F.col("attack_type") != "safe").alias("is_attack"), F.col("attack_confidence").alias("confidence"))
    return stats.prediction_summary(p).withColumn("avg_confidence", F.round("avg_confidence", 6))


@R.add("e19_hour_status", WITH_E + """
SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) FILTER (severity NOT IN ('critical', 'error')) AS normal, count(*) FILTER (severity IN ('critical', 'error')) AS anomaly FROM entries GROUP BY 1 ORDER BY 1 DESC LIMIT 24""")
def e19(spark, d):
    e = entries(spark, d).withColumn("attack_type", F.lit(None).cast("string"))
    return stats.hour_status(e, 24).select(us("hour").alias("hour_us"), "normal", "anomaly")


# --- windows --------------------------------------------------------------------------------------------

_FAILS = "f AS (SELECT id, ip, usr AS user, us FROM entries WHERE outcome = 'failure' AND is_auth)"


@R.add("f1_bruteforce", WITH_E + f", {_FAILS}" + f""",
c AS (SELECT a.ip, a.user, a.us AS start_us, count(*) AS failures, max(b.us) AS end_us FROM (SELECT DISTINCT ip, user, us FROM f) a JOIN f b ON a.ip = b.ip AND a.user = b.user AND b.us BETWEEN a.us AND a.us + {WEEK_US} GROUP BY ALL)
SELECT * FROM c WHERE failures >= 3 QUALIFY row_number() OVER (PARTITION BY ip, user ORDER BY start_us) = 1""")
def f1(spark, d):
    return windows.bruteforce(entries(spark, d), 3, WEEK_MINUTES)


@R.add("f2_password_spray", WITH_E + f", {_FAILS}" + f""",
c AS (SELECT a.ip, a.us AS start_us, count(DISTINCT b.user) AS users, max(b.us) AS end_us FROM (SELECT DISTINCT ip, us FROM f) a JOIN f b ON a.ip = b.ip AND b.us BETWEEN a.us AND a.us + {DAY_US} GROUP BY ALL)
SELECT * FROM c WHERE users >= 3 QUALIFY row_number() OVER (PARTITION BY ip ORDER BY start_us) = 1""")
def f2(spark, d):
    return windows.password_spray(entries(spark, d), 3, DAY_MINUTES)


@R.add("f3_success_after_failures", _SAF + f"""
SELECT s.id, s.usr AS user, s.us, count(*) AS failures FROM s JOIN f ON s.usr = f.usr AND f.us < s.us AND f.us >= s.us - {WEEK_US} GROUP BY ALL HAVING count(*) >= 3""")
def f3(spark, d):
    return windows.success_after_failures(entries(spark, d), 3, WEEK_MINUTES)


@R.add("f3_failing_sources", _SAF + f""",
a AS (SELECT s.id, s.usr, s.us, count(*) AS n FROM s JOIN f ON s.usr = f.usr AND f.us < s.us AND f.us >= s.us - {WEEK_US} GROUP BY ALL HAVING count(*) >= 3)
SELECT DISTINCT a.id, f.ip FROM a JOIN f ON a.usr = f.usr AND f.us < a.us AND f.us >= a.us - {WEEK_US}""")
def f3b(spark, d):
    e = entries(spark, d)
    return windows.failing_sources(e, windows.success_after_failures(e, 3, WEEK_MINUTES), WEEK_MINUTES)


@R.add("f4_anchored_windows", _WITH_W + " SELECT us, window_us FROM wins")
def f4(spark, d):
    return windows.anchored_windows(entries(spark, d).withColumn("us", us()), [], DAY_MINUTES)


@R.add("f4_anchored_windows_by_user", "WITH RECURSIVE " + ENTRIES_SQL + f""",
w(usr, s) AS (SELECT usr, min(us) FROM entries GROUP BY usr UNION ALL SELECT w.usr, min(e.us) FROM w JOIN entries e ON e.usr = w.usr AND e.us > w.s + {DAY_US} GROUP BY w.usr, w.s)
SELECT e.usr AS user, e.us, max(w.s) AS window_us FROM (SELECT DISTINCT usr, us FROM entries) e JOIN w ON w.usr = e.usr AND w.s <= e.us GROUP BY 1, 2""")
def f4b(spark, d):
    e = entries(spark, d).select(F.col("user.name").alias("user"), us().alias("us"))
    return windows.anchored_windows(e, ["user"], DAY_MINUTES)


@R.add("f5_bruteforce_chain", _WITH_W + f", {_BFCHAIN} SELECT *, round(least(0.7::DOUBLE + failures / 50, 0.95), 6) AS confidence FROM bfc")
def f5(spark, d):
    return _bf_chains(entries(spark, d)).withColumn("confidence", F.round("confidence", 6))


@R.add("f6_spray_chain", _WITH_W + """
SELECT *, round(least(0.7::DOUBLE + users / 50, 0.95), 6) AS confidence FROM (
 SELECT window_us, ip, count(DISTINCT usr) AS users, min(us) AS start_us, max(us) AS end_us FROM entries JOIN wins USING (us) WHERE outcome = 'failure' GROUP BY 1, 2 HAVING count(DISTINCT usr) >= 3)""")
def f6(spark, d):
    return windows.spray_chain(entries(spark, d), 3, DAY_MINUTES, DAY_MINUTES).withColumn("confidence", F.round("confidence", 6))


@R.add("f7_burst", WITH_E + f""",
m AS (SELECT ip, min(us) AS s FROM entries GROUP BY ip)
SELECT e.ip, count(*) AS events, min(e.us) AS start_us, max(e.us) AS end_us FROM entries e JOIN m USING (ip) WHERE e.us - m.s < {2 * DAY_US} GROUP BY e.ip HAVING count(*) >= 3""")
def f7(spark, d):
    return windows.burst(entries(spark, d), 3, 2 * 86400)


@R.add("f8_burstiness", WITH_E + """,
g AS (SELECT ip, us, (us - lag(us) OVER (PARTITION BY ip ORDER BY us)) / 1000.0::DOUBLE AS gap FROM entries)
SELECT ip, count(*) AS events, round(CASE WHEN count(*) > 5 THEN least(stddev_pop(gap) / avg(gap), 2.0) ELSE 0.0 END, 4) AS burstiness FROM g GROUP BY ip""")
def f8(spark, d):
    e = entries(spark, d).withColumn("ip", F.col("source.ip"))
    return windows.burstiness(e, ["ip"]).withColumn("burstiness", F.round("burstiness", 4))


@R.add("f12_zscore_outliers", """
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)
SELECT event_id, round(abs(value - m) / sd, 6) AS zscore FROM events, s WHERE abs(value - m) / sd > 3""")
def f12(spark, d):
    ev = table(spark, d, "events")
    return windows.zscore_outliers(ev, "value").select("event_id", F.round("zscore", 6).alias("zscore"))


# --- sorts, limits, sets --------------------------------------------------------------------------------


@R.add("g1_sort_by", WITH_E + "SELECT id, action FROM entries WHERE log_type = 'syslog' ORDER BY lower(coalesce(action, '')) DESC, id")
def g1(spark, d):
    return query.sort_by(entries(spark, d).where("log_type = 'syslog'"), "action", True).select("id", "action")


@R.add("g2_most_recent", WITH_E + "SELECT id, us FROM entries ORDER BY us DESC, id LIMIT 50")
def g2(spark, d):
    return query.most_recent(entries(spark, d), 50).select("id", us().alias("us"))


@R.add("g3_rank_findings", WITH_E + "SELECT ip AS filename, count(*) AS score FROM entries GROUP BY 1 ORDER BY 2 DESC, 1")
def g3(spark, d):
    f = entries(spark, d).groupBy(F.col("source.ip").alias("filename")).agg(F.count("*").alias("score"))
    return query.rank_findings(f)


@R.add("g4_first_per_group", WITH_E + "SELECT ip, id, row_number() OVER (PARTITION BY ip ORDER BY us, id) AS rn FROM entries QUALIFY rn <= 10")
def g4(spark, d):
    e = entries(spark, d).withColumn("ip", F.col("source.ip"))
    return query.first_per_group(e, ["ip"], ["ts", "id"], 10).select("ip", "id", F.col("rn").cast("bigint").alias("rn"))


@R.add("g5_union_frames", WITH_E + "SELECT id, 'a' AS part, port::VARCHAR AS port FROM entries WHERE outcome = 'failure' UNION ALL SELECT id, 'b', NULL FROM entries WHERE outcome = 'success'")
def g5(spark, d):
    e = entries(spark, d)
    a = e.where("outcome = 'failure'").select("id", F.lit("a").alias("part"), F.col("source.port").cast("string").alias("port"))
    return query.union_frames(a, e.where("outcome = 'success'").select("id", F.lit("b").alias("part")))


@R.add("g6_dedupe", WITH_E + "SELECT DISTINCT ip, log_type FROM entries")
def g6(spark, d):
    return query.dedupe(entries(spark, d).select(F.col("source.ip").alias("ip"), "log_type"), ["ip", "log_type"])


@R.add("g7_set_overlap", WITH_E + """,
a AS (SELECT DISTINCT usr, ip FROM entries WHERE outcome = 'failure'), b AS (SELECT DISTINCT usr, ip FROM entries WHERE outcome = 'success')
SELECT coalesce(a.usr, b.usr) AS user, count(*) FILTER (a.ip IS NOT NULL AND b.ip IS NOT NULL) AS shared, count(*) FILTER (b.ip IS NULL) AS left_only, count(*) FILTER (a.ip IS NULL) AS right_only
FROM a FULL JOIN b ON a.usr = b.usr AND a.ip = b.ip GROUP BY 1""")
def g7(spark, d):
    e = entries(spark, d).select(F.col("user.name").alias("user"), F.col("source.ip").alias("ip"), "outcome")
    return query.set_overlap(e.where("outcome = 'failure'"), e.where("outcome = 'success'"), ["user"], "ip")


# --- scalar functions and features ----------------------------------------------------------------------


@R.add("h1_entropy", """
WITH c AS (SELECT doc_id, ch, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY 1, 2),
s AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM c)
SELECT doc_id, round(-sum(p * log2(p)), 5) AS entropy FROM s GROUP BY 1""")
def h1(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.round(scalars.entropy(F.col("text")), 5).alias("entropy"))


def _feature_sql() -> str:
    text = "lower(message)"
    parts = ["CAST(NOT regexp_matches(ip, '^(192\\.168\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01]))') AS INTEGER)::DOUBLE AS is_external_ip",
             f"round(least(length({text}) / 500.0, 1.0)::DOUBLE, 6) AS message_length", "CAST(outcome = 'failure' AS INTEGER)::DOUBLE AS has_failure",
             "CAST(severity IN ('warning', 'error', 'critical') AS INTEGER)::DOUBLE AS severity_level",
             "CAST(usr IN ('', 'anonymous', 'www-data', 'nobody', 'root') AS INTEGER)::DOUBLE AS is_anonymous",
             "round(least((" + " + ".join(f"contains({text}, {quoted(w)})::INTEGER" for w in attacks.SENSITIVE_WORDS) + ") / 3.0, 1.0)::DOUBLE, 6) AS sensitive_words",
             f"CAST(coalesce(contains(lower(action), 'login'), false) OR contains({text}, 'auth') OR contains({text}, 'password') AS INTEGER)::DOUBLE AS is_login"]
    for name, p in attacks.FEATURE_COUNTS:
        parts.append(f"round(least(len(regexp_extract_all({text}, {quoted(p)})) / 3.0, 1.0)::DOUBLE, 6) AS {name}")
    for name, p in attacks.FEATURE_FLAGS:
        parts.append(f"CAST(regexp_matches({text}, {quoted(p)}) AS INTEGER)::DOUBLE AS {name}")
    return ", ".join(parts)


@R.add("h2_attack_features", WITH_E + f" SELECT id, {_feature_sql()} FROM entries")
def h2(spark, d):
    out = features.attack_features(entries(spark, d))
    return out.select("id", *[F.round(c, 6).alias(c) for c in features.ATTACK_FEATURES])


@R.add("h3_behaviour_features", WITH_E + """
SELECT id, round(length(message) / 1000.0::DOUBLE, 6) AS length, CASE severity WHEN 'debug' THEN 0.0 WHEN 'info' THEN 1.0 WHEN 'warning' THEN 2.0 WHEN 'error' THEN 3.0 WHEN 'critical' THEN 4.0 END::DOUBLE AS severity_code,
  round((CASE WHEN f_status IS NULL THEN 1 ELSE 2 END) / 10.0::DOUBLE, 6) AS n_fields, round(hour(ts) / 24.0::DOUBLE, 6) AS hour, round((isodow(ts) - 1) / 7.0::DOUBLE, 6) AS weekday FROM entries""")
def h3(spark, d):
    out = features.behaviour_features(entries(spark, d))
    return out.select("id", *[F.round(c, 6).alias(c) for c in features.BEHAVIOUR_FEATURES if not c.endswith("_hash")])


@R.add("h4_tabular_features", WITH_E + """
SELECT id, hour(ts)::DOUBLE AS f_hour, (isodow(ts) - 1)::DOUBLE AS f_weekday, length(message)::DOUBLE AS f_length, coalesce(f_status::DOUBLE, 0.0) AS n_status, coalesce(f_bytes::DOUBLE, 0.0) AS n_bytes,
  log_type AS c_log_type, severity AS c_severity, coalesce(action, 'unknown') AS c_action, outcome AS c_outcome FROM entries""")
def h4(spark, d):
    out = features.tabular_features(entries(spark, d))
    return out.select("id", "f_hour", "f_weekday", "f_length", "n_status", "n_bytes", "c_log_type", "c_severity", "c_action", "c_outcome")


@R.add("h5_off_hours", WITH_E + "SELECT id, hour(ts) < 6 OR hour(ts) > 22 AS off_hours FROM entries")
def h5(spark, d):
    return entries(spark, d).select("id", scalars.off_hours(F.col("ts")).alias("off_hours"))


@R.add("h6_clip_unit", "SELECT event_id, round(least(greatest((value - 10) / 190, 0), 1)::DOUBLE, 6) AS unit FROM events")
def h6(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scalars.clip_unit(F.col("value"), 10, 200), 6).alias("unit"))


@R.add("h7_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value / 100))), 6) AS p FROM events")
def h7(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scalars.sigmoid(F.col("value") / 100), 6).alias("p"))


@R.add("h9_titles_and_durations", WITH_E + """
SELECT id, CASE WHEN action IS NOT NULL THEN ip || ' ' || action ELSE usr || ' ' || outcome END AS title,
  CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.0f', ms / 1000) || 's' WHEN ms < 3600000 THEN printf('%.0f', ms / 60000) || 'm' ELSE printf('%.1f', ms / 3600000) || 'h' END AS duration
FROM (SELECT *, port * port AS ms FROM entries)""")
def h9(spark, d):
    e = entries(spark, d)
    return e.select(
        "id", scalars.event_title(F.col("source.ip"), F.col("action"), F.col("user.name"), F.col("outcome"), F.col("severity")).alias("title"),
        scalars.human_duration(F.col("source.port") * F.col("source.port")).alias("duration"),
    )


_ORD = "CASE "
for _n, _p in attacks.ORDERED_RULES:
    _ORD += f"WHEN regexp_matches(txt, {quoted(detect.any_of(_p))}) THEN {quoted(_n)} "
_ORD += "END"
_ORDC = "CASE "
for _n, _p in attacks.ORDERED_RULES:
    _hits = " + ".join(f"regexp_matches(txt, {quoted('(?i)' + x)})::INTEGER" for x in _p)
    _ORDC += f"WHEN regexp_matches(txt, {quoted(detect.any_of(_p))}) THEN round(least(0.5 + ({_hits}) * 0.15, 0.95)::DOUBLE, 6) "
_ORDC += "END"
WITH_O = WITH_E + f", o AS (SELECT *, {_ORD} AS tag, {_ORDC} AS tag_confidence FROM (SELECT *, lower(message) || ' ' || lower(message) || ' ' || lower(coalesce(action, '')) AS txt FROM entries))"


@R.add("h10_attack_stage", WITH_O + """,
c AS (SELECT ip, tag, bool_or(outcome = 'success') AS w, bool_or(outcome = 'failure') AS f, count(DISTINCT log_source) AS n FROM o WHERE tag IS NOT NULL GROUP BY 1, 2)
SELECT ip, tag, CASE WHEN tag IN ('bruteforce', 'password_spray') THEN CASE WHEN w THEN 'initial_access' ELSE 'reconnaissance' END WHEN tag IN ('sql_injection', 'xss_attack', 'command_injection') THEN 'execution'
  WHEN tag = 'ransomware' THEN 'complete' WHEN tag = 'webshell' THEN 'persistence' WHEN n > 2 THEN 'execution' WHEN w AND NOT f THEN 'complete' ELSE 'execution' END AS stage FROM c""")
def h10(spark, d):
    s = correlate.slim(entries(spark, d)).where("tag IS NOT NULL")
    g = s.groupBy("ip", "tag").agg(F.bool_or(F.col("outcome") == "success").alias("w"), F.bool_or(F.col("outcome") == "failure").alias("f"), F.countDistinct("log_source").alias("n"))
    return g.select("ip", "tag", scalars.attack_stage(F.col("tag"), F.col("w"), F.col("f"), F.col("n")).alias("stage"))


_ADVICE = "CASE attack_type " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in dims.ADVICE.items()) + f" ELSE {quoted(dims.ADVICE_DEFAULT)} END"


@R.add("h11_recommendations", WITH_T + f", {_IPCHAIN}" + f""",
l AS (SELECT CASE WHEN end_us > start_us THEN 'Attack occurred over ' || printf('%.1f', (end_us - start_us) / 60000000) || ' minutes. ' ELSE '' END || {_ADVICE} AS recommendation FROM ipchains
 UNION SELECT {quoted(dims.EXTRA_ADVICE['bruteforce'])} FROM ipchains WHERE attack_type = 'bruteforce' UNION SELECT {quoted(dims.EXTRA_ADVICE['sql_injection'])} FROM ipchains WHERE attack_type = 'sql_injection')
SELECT recommendation FROM l""")
def h11(spark, d):
    c = correlate.ip_chains(tagged(spark, d)).withColumns({"start_us": us("start_ts"), "end_us": us("end_ts")})
    return correlate.recommendations(c)


_SEV = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.SEVERITY_SCORE.items()) + " ELSE 0.5 END"


@R.add("h12_correlated_events", WITH_E + f"SELECT id, ip AS source_ip, dst_host AS target_host, message, round(least(0.5 + 0.5 * 0.4, {_SEV})::DOUBLE, 6) AS correlation_score FROM entries")
def h12(spark, d):
    out = correlate.correlated_events(correlate.slim(entries(spark, d)), 0.4)
    return out.select("id", "source_ip", "target_host", "message", F.round("correlation_score", 6).alias("correlation_score"))


# --- tags and alerts ------------------------------------------------------------------------------------


@R.add("r1_tag_keywords", WITH_T + "SELECT id, attack_type, attack_confidence, severity FROM t")
def r1(spark, d):
    return tagged(spark, d).select("id", "attack_type", "attack_confidence", "severity")


@R.add("r1_tag_keywords_pages", f"SELECT page_id, {_keyword_case(lambda n, w: quoted(n))} ELSE 'safe' END AS attack_type FROM (SELECT page_id, html AS message FROM pages)")
def r1b(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("html").alias("message"), F.lit("info").alias("severity"))
    return detect.tag_keywords(p).select("page_id", "attack_type")


def _category_sql() -> str:
    rows = []
    cats = {"nginx": "webserver", "mysql_error": "database", "ssh_auth": "authentication", "syslog": "syslog", "iptables": "firewall"}
    for log_type, cat in cats.items():
        for order, (_, name, weight, patterns) in enumerate(r for r in attacks.CATEGORY_RULES if r[0] == cat):
            hits = " + ".join(f"regexp_matches(message, {quoted(attacks.category_pattern(p))})::INTEGER" for p in patterns)
            rows.append(f"SELECT id, '{cat}' AS category, {order} AS o, '{name}' AS attack_type, {hits} AS hits, {weight}::DOUBLE AS w FROM entries WHERE log_type = '{log_type}'")
    return " UNION ALL ".join(rows)


@R.add("r2_tag_by_category", WITH_E + f""",
h AS ({_category_sql()}), b AS (SELECT *, round(least(w + hits * 0.1, 0.95), 6) AS attack_confidence FROM h WHERE hits > 0)
SELECT id, category, attack_type, attack_confidence, hits::BIGINT AS hits FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY attack_confidence DESC, o) = 1""")
def r2(spark, d):
    out = detect.tag_by_category(entries(spark, d)).where("attack_type IS NOT NULL")
    return out.select("id", "category", "attack_type", "attack_confidence", F.size("matched_patterns").cast("bigint").alias("hits"))


@R.add("r3_tag_ordered", WITH_O + "SELECT id, tag AS attack_type, tag_confidence AS attack_confidence FROM o")
def r3(spark, d):
    return detect.tag_ordered(entries(spark, d)).select("id", "attack_type", "attack_confidence")


@R.add("r4_types_for", WITH_E + ", lt AS (SELECT DISTINCT log_type, CASE log_type WHEN 'nginx' THEN 'webserver' WHEN 'mysql_error' THEN 'database' WHEN 'ssh_auth' THEN 'authentication' WHEN 'syslog' THEN 'syslog' ELSE 'firewall' END AS category FROM entries), r(category, attack_type, weight) AS (VALUES "
       + ", ".join(f"('{c}', '{t}', {w}::DOUBLE)" for c, t, w, _ in attacks.CATEGORY_RULES) + ") SELECT log_type, attack_type, weight FROM lt JOIN r USING (category)")
def r4(spark, d):
    return detect.types_for(entries(spark, d)).select("log_type", "attack_type", "weight")


@R.add("r4_attack_catalogue", WITH_O + ", c(attack_type, description) AS (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in dims.ATTACK_CATALOGUE.items())
       + ") SELECT c.attack_type, c.description, (SELECT count(*) FROM o WHERE o.tag = c.attack_type) AS entries FROM c")
def r4b(spark, d):
    seen = correlate.slim(entries(spark, d)).groupBy(F.col("tag").alias("attack_type")).agg(F.count("*").alias("entries"))
    cat = detect.attack_catalogue(spark)
    return cat.join(seen, "attack_type", "left").select("attack_type", "description", F.coalesce("entries", F.lit(0)).alias("entries"))


@R.add("r5_entry_alerts", WITH_T + """
SELECT id, attack_type AS type, severity, attack_confidence AS confidence, 'Detected ' || CASE attack_type WHEN 'bruteforce' THEN 'Bruteforce' WHEN 'sql_injection' THEN 'Sql Injection' WHEN 'xss_attack' THEN 'Xss Attack' WHEN 'threat_intel' THEN 'Threat Intel' ELSE 'Spam Activity' END AS title,
  CASE attack_type WHEN 'bruteforce' THEN 'Credential Access' WHEN 'sql_injection' THEN 'Initial Access,Execution' WHEN 'xss_attack' THEN 'Initial Access' WHEN 'threat_intel' THEN 'Reconnaissance' ELSE 'Resource Hijacking' END AS tactics FROM t WHERE attack_type <> 'safe'""")
def r5(spark, d):
    return detect.entry_alerts(tagged(spark, d)).select("id", "type", "severity", "confidence", "title", F.array_join("mitre_tactics", ",").alias("tactics"))


@R.add("r6_port_scan", WITH_E + f", {_PROFILE} SELECT ip, ports, last_us FROM p WHERE ports >= 10")
def r6(spark, d):
    return detect.port_scan(stats.ip_profile(entries(spark, d))).withColumn("last_us", us("last_ts")).drop("last_ts")


@R.add("r7_bruteforce_batch", WITH_E + f", {_PROFILE} SELECT ip, failures, CASE WHEN failures >= 15 THEN 'high' ELSE 'medium' END AS severity, last_us FROM p WHERE failures >= 5")
def r7(spark, d):
    return detect.bruteforce_batch(stats.ip_profile(entries(spark, d))).withColumn("last_us", us("last_ts")).drop("last_ts")


@R.add("r8_credential_stuffing", WITH_E + f", {_PROFILE} SELECT ip, users, failures, last_us FROM p WHERE users >= 3 AND failures >= 5")
def r8(spark, d):
    return detect.credential_stuffing(stats.ip_profile(entries(spark, d))).withColumn("last_us", us("last_ts")).drop("last_ts")


@R.add("r9_excess_privilege", WITH_E + "SELECT usr AS user, count(*) AS operations FROM entries WHERE action = 'sudo' GROUP BY 1 HAVING count(*) > 10")
def r9(spark, d):
    return detect.excess_privilege(entries(spark, d), 10)


@R.add("r9_privilege_related", WITH_E + """,
u AS (SELECT usr FROM entries WHERE action = 'sudo' GROUP BY 1 HAVING count(*) > 10)
SELECT usr AS user, id, row_number() OVER (PARTITION BY usr ORDER BY us, id) AS rn FROM entries WHERE action = 'sudo' AND usr IN (SELECT usr FROM u) QUALIFY rn <= 10""")
def r9b(spark, d):
    e = entries(spark, d)
    return detect.privilege_related(e, detect.excess_privilege(e, 10), 10).select("user", "id", F.col("rn").cast("bigint").alias("rn"))


@R.add("r10_anomaly_alerts", WITH_T + """
SELECT id, 'Unusual pattern detected in ' || log_type || ' log (score: ' || printf('%.2f', anomaly_score) || ')' AS description FROM t WHERE is_anomaly AND attack_type = 'safe'""")
def r10(spark, d):
    e = tagged(spark, d)
    return detect.anomaly_alerts(e, detect.entry_alerts(e)).select("id", "description")


_CFG = detect.DetectionConfig(bruteforce_n=3, bruteforce_minutes=WEEK_MINUTES, spray_n=3, spray_minutes=DAY_MINUTES, success_n=3, success_minutes=WEEK_MINUTES, privilege_more_than=10)


_RUN = f""", {_PROFILE}, {_FAILS},
f1 AS (SELECT a.ip, a.user, a.us, count(*) AS n FROM (SELECT DISTINCT ip, user, us FROM f) a JOIN f b ON a.ip = b.ip AND a.user = b.user AND b.us BETWEEN a.us AND a.us + {WEEK_US} GROUP BY ALL HAVING count(*) >= 3),
f2 AS (SELECT a.ip, a.us, count(DISTINCT b.user) AS n FROM (SELECT DISTINCT ip, us FROM f) a JOIN f b ON a.ip = b.ip AND b.us BETWEEN a.us AND a.us + {DAY_US} GROUP BY ALL HAVING count(DISTINCT b.user) >= 3),
s AS (SELECT id, usr, us FROM entries WHERE outcome = 'success' AND is_auth),
f3 AS (SELECT s.id, s.usr, count(*) AS n FROM s JOIN f ON s.usr = f.user AND f.us < s.us AND f.us >= s.us - {WEEK_US} GROUP BY s.id, s.usr HAVING count(*) >= 3),
alerts AS (SELECT 'bruteforce' AS type, ip, user, arg_min(n, us) AS hits FROM f1 GROUP BY ip, user UNION ALL SELECT 'password_spray', ip, '', arg_min(n, us) FROM f2 GROUP BY ip UNION ALL SELECT 'suspicious_activity', '', usr, n FROM f3
 UNION ALL SELECT 'privilege_escalation', '', usr, count(*) FROM entries WHERE action = 'sudo' GROUP BY usr HAVING count(*) > 10 UNION ALL SELECT 'port_scan', ip, '', ports FROM p WHERE ports >= 10
 UNION ALL SELECT 'bruteforce', ip, '', failures FROM p WHERE failures >= 5 UNION ALL SELECT 'credential_stuffing', ip, '', users FROM p WHERE users >= 3 AND failures >= 5)"""
#: Configuration and twin of the job over entries without tags: a row per alert.
DETECTIONS, DETECTIONS_SQL = _CFG, WITH_E + _RUN + " SELECT type, ip, user, hits::BIGINT AS hits FROM alerts"


@R.add("r11_run_detections", WITH_T + _RUN + """
SELECT type, count(*) AS alerts, sum(hits)::BIGINT AS hits FROM (SELECT type, hits FROM alerts UNION ALL SELECT attack_type, 1 FROM t WHERE attack_type <> 'safe') GROUP BY type""")
def r11(spark, d):
    return detect.run_detections(entries(spark, d), _CFG, tagged(spark, d)).groupBy("type").agg(F.count("*").alias("alerts"), F.sum("hits").alias("hits"))


# --- chains ---------------------------------------------------------------------------------------------


@R.add("k1_ip_chains", WITH_T + f", {_IPCHAIN} SELECT * FROM ipchains")
def k1(spark, d):
    c = correlate.ip_chains(tagged(spark, d))
    return c.select("ip", "attack_type", "stage", "events", "services", F.round("confidence", 6).alias("confidence"), us("start_ts").alias("start_us"), us("end_ts").alias("end_us"))


@R.add("k2_distributed_bruteforce", WITH_E + f", {_UPROFILE} SELECT user, ips, failures, start_us, end_us FROM up WHERE ips >= 3 AND failures >= 5")
def k2(spark, d):
    c = correlate.distributed_bruteforce(entries(spark, d))
    return c.select("user", "ips", "failures", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"))


@R.add("k3_account_compromise", WITH_E + f", {_UPROFILE} SELECT user, ips, failures, successes, shared_ips FROM up WHERE failures > 0 AND successes > 0 AND (shared_ips > 0 OR failures > 10)")
def k3(spark, d):
    return correlate.account_compromise(entries(spark, d)).select("user", "ips", "failures", "successes", "shared_ips")


@R.add("k4_suspicious_timeline", WITH_T + "SELECT id, us, attack_type AS event_type, 'Suspicious activity in ' || log_type AS title, message AS description, is_anomaly FROM t WHERE attack_type <> 'safe' OR is_anomaly ORDER BY us, id")
def k4(spark, d):
    return correlate.suspicious_timeline(tagged(spark, d)).select("id", us().alias("us"), "event_type", "title", "description", "is_anomaly")


_KEYC = """{k}c AS (SELECT {k} AS key, count(*) AS events, arg_min(tag, (us, id)) FILTER (tag IS NOT NULL) AS attack_type, arg_min(tag_confidence, (us, id)) FILTER (tag IS NOT NULL) AS confidence, min(us) AS start_us, max(us) AS end_us
  FROM {src} GROUP BY {k} HAVING count(*) >= 3 AND count(tag) > 0)"""
_IPC = _KEYC.format(k="ip", src="o")
_COVER = "cov AS (SELECT o.id, o.ip, row_number() OVER (PARTITION BY o.ip ORDER BY us, id) AS rn FROM o JOIN ipc ON o.ip = ipc.key)"
_REST = "rest0 AS (SELECT * FROM o WHERE id NOT IN (SELECT id FROM cov)), rest AS (SELECT * FROM rest0 WHERE usr IN (SELECT usr FROM rest0 GROUP BY usr HAVING count(*) >= 3))"


@R.add("k5_ip_attack_chain", WITH_O + f", {_IPC} SELECT key, attack_type, confidence, events, start_us, end_us FROM ipc")
def k5(spark, d):
    return correlate.ip_attack_chain(correlate.slim(entries(spark, d))).select("key", "attack_type", "confidence", "events", "start_us", "end_us")


def _uncovered(spark, d):
    s = cut_lineage(correlate.slim(entries(spark, d)))
    ev = correlate.chain_events(s, correlate.ip_attack_chain(s), "ip")
    return s, ev, correlate.uncovered(s, ev)


@R.add("d5_uncovered_entries", WITH_O + f", {_IPC}, {_COVER}, {_REST} SELECT id, usr AS user FROM rest")
def d5(spark, d):
    return _uncovered(spark, d)[2].select("id", F.col("usr").alias("user"))


@R.add("k6_user_attack_chain", WITH_O + f", {_IPC}, {_COVER}, {_REST}, {_KEYC.format(k='usr', src='rest')} SELECT key, attack_type, confidence, events, start_us, end_us FROM usrc")
def k6(spark, d):
    return correlate.user_attack_chain(_uncovered(spark, d)[2]).select("key", "attack_type", "confidence", "events", "start_us", "end_us")


@R.add("d4_first_chain_of_event", WITH_O + f", {_IPC}, {_COVER} SELECT o.id, 'ip:' || cov.ip AS chain_id, cov.id IS NOT NULL AS is_anomaly, coalesce(ipc.confidence, 0.0)::DOUBLE AS anomaly_score FROM o LEFT JOIN cov USING (id) LEFT JOIN ipc ON ipc.key = cov.ip")
def d4(spark, d):
    s, ev, _ = _uncovered(spark, d)
    return correlate.timeline(s, ev, correlate.ip_attack_chain(s)).select("id", "chain_id", "is_anomaly", "anomaly_score")


@R.add("k7_sqli_chain", WITH_E + f""",
w AS (SELECT id, us, ip FROM entries WHERE log_source = 'web' AND ({_SQLI}))
SELECT w.ip AS key, w.us AS start_us, b.us AS end_us, w.id AS web_id, b.id AS db_id FROM w JOIN entries b ON b.log_source = 'database' AND b.us > w.us AND b.us < w.us + {600 * SECOND} ORDER BY w.us, w.id, b.us, b.id LIMIT 1""")
def k7(spark, d):
    return correlate.sqli_chain(correlate.slim(entries(spark, d)), 600).select("key", "start_us", "end_us", "web_id", "db_id")


_TAKE = """tk AS (SELECT usr AS user, count(*) FILTER (outcome = 'failure') AS failures, count(*) FILTER (outcome = 'success') AS successes, count(DISTINCT ip) FILTER (outcome = 'failure') AS failing_ips, min(us) FILTER (outcome = 'failure') AS start_us, min(us) FILTER (outcome = 'success') AS end_us, min((us, id)) AS first
  FROM entries WHERE log_source = 'auth' GROUP BY usr HAVING count(*) FILTER (outcome = 'failure') >= 2 AND count(*) FILTER (outcome = 'success') > 0)"""


@R.add("k8_account_takeover", WITH_E + f", {_TAKE} SELECT user, failures, successes, failing_ips, start_us, end_us FROM tk")
def k8(spark, d):
    c = correlate.account_takeover(correlate.slim(entries(spark, d)), 2)
    return c.select(F.col("usr").alias("user"), "failures", "successes", "failing_ips", "start_us", "end_us")


def _admin(spark, d):
    """Entries whose user names are administrative for every tenth user."""
    e = entries(spark, d)
    name = F.when(F.substring("user.name", -1, 1) == "0", F.concat(F.lit("admin"), F.col("user.name"))).otherwise(F.col("user.name"))
    return e.withColumn("user", F.struct(name.alias("name"), F.lit(None).cast("string").alias("domain")))


@R.add("k9_privileged_access", WITH_E + """
SELECT count(*) AS events, min(us) AS start_us, max(us) AS end_us, count(DISTINCT ip) AS ips, count(DISTINCT usr) AS users FROM entries WHERE log_source = 'auth' AND outcome = 'success' AND right(usr, 1) = '0' HAVING count(*) >= 1""")
def k9(spark, d):
    return correlate.privileged_access(correlate.slim(_admin(spark, d))).select("events", "start_us", "end_us", "ips", "users")


@R.add("k10_ransomware", WITH_E + f"SELECT count(*) AS events, min(us) AS start_us, max(us) AS end_us, count(DISTINCT ip) AS ips FROM entries WHERE log_source = 'system' AND regexp_matches(message, {quoted(attacks.RANSOMWARE)}) HAVING count(*) >= 2")
def k10(spark, d):
    return correlate.ransomware(correlate.slim(entries(spark, d))).select("events", "start_us", "end_us", "ips")


@R.add("k11_webshell", WITH_E + f"SELECT count(*) AS events, min(us) AS start_us, max(us) AS end_us, count(DISTINCT ip) AS ips FROM entries WHERE log_source = 'web' AND regexp_matches(message, {quoted(attacks.WEBSHELL)}) HAVING count(*) >= 1")
def k11(spark, d):
    return correlate.webshell(correlate.slim(entries(spark, d))).select("events", "start_us", "end_us", "ips")


@R.add("k12_auth_bruteforce", WITH_E + "SELECT ip, count(*) AS failures, min(us) AS start_us, max(us) AS end_us FROM entries WHERE log_source = 'auth' AND outcome = 'failure' GROUP BY ip HAVING count(*) >= 3")
def k12(spark, d):
    return correlate.auth_bruteforce(correlate.slim(entries(spark, d)), 3).select("ip", "failures", "start_us", "end_us")


_TAKE5 = _TAKE.replace(">= 2", ">= 5")
_KILL = f"""w AS (SELECT id, us, ip FROM entries WHERE log_source = 'web' AND ({_SQLI})),
pr AS (SELECT w.id AS web_id, w.us AS wus, b.id AS db_id, b.us AS bus FROM w JOIN entries b ON b.log_source = 'database' AND b.us > w.us AND b.us < w.us + {600 * SECOND} ORDER BY w.us, w.id, b.us, b.id LIMIT 1),
{_TAKE5}, br AS (SELECT ip, min((us, id)) AS first FROM entries WHERE log_source = 'auth' AND outcome = 'failure' GROUP BY ip HAVING count(*) >= 5),
rw AS (SELECT id, us FROM entries WHERE log_source = 'system' AND regexp_matches(message, {quoted(attacks.RANSOMWARE)})),
kill AS (
  SELECT 'kill:sql_injection' AS chain_id, web_id AS event_id FROM pr UNION ALL SELECT 'kill:sql_injection', db_id FROM pr
  UNION ALL (SELECT 'kill:account_takeover', id FROM entries WHERE log_source = 'auth' AND outcome IN ('failure', 'success') AND usr = (SELECT arg_min(user, first) FROM tk))
  UNION ALL (SELECT 'kill:ransomware', id FROM rw WHERE (SELECT count(*) FROM rw) >= 2)
  UNION ALL (SELECT 'kill:webshell', id FROM entries WHERE log_source = 'web' AND regexp_matches(message, {quoted(attacks.WEBSHELL)}))
  UNION ALL (SELECT 'kill:bruteforce', id FROM entries WHERE log_source = 'auth' AND outcome = 'failure' AND ip = (SELECT arg_min(ip, first) FROM br)))"""


@R.add("k13_kill_chains", WITH_E + f", {_KILL} SELECT chain_id, event_id FROM kill")
def k13(spark, d):
    return correlate.kill_chain_events(correlate.slim(entries(spark, d)), 600).select("chain_id", "event_id")


@R.add("d6_drop_overlapping", WITH_O + f", {_IPC}, {_COVER}" + f""",
m AS (SELECT ip, min(us) AS s FROM entries GROUP BY ip),
b AS (SELECT e.ip, e.id, e.us FROM entries e JOIN m USING (ip) WHERE e.us - m.s < {2 * DAY_US}), n AS (SELECT ip FROM b GROUP BY ip HAVING count(*) >= 3),
late AS (SELECT id FROM cov WHERE rn > 20)
SELECT 'burst:' || ip AS chain_id FROM n WHERE ip NOT IN (SELECT b.ip FROM b JOIN late USING (id))""")
def d6(spark, d):
    e = entries(spark, d)
    s = correlate.slim(e)
    rows = s.select("id", "us", "ip").join(correlate.chain_events(s, correlate.ip_attack_chain(s), "ip").select(F.col("event_id").alias("id"), "chain_id"), "id")
    late = rows.withColumn("rn", F.row_number().over(Window.partitionBy("chain_id").orderBy("us", "id"))).where("rn > 20").select(F.col("id").alias("event_id"))
    bursts = correlate.burst_chains(e, 3, 2 * 86400)
    events = s.select("id", "us", F.col("ip").alias("key")).join(bursts.select("key", "chain_id", "end_us"), "key").where("us <= end_us").select("chain_id", F.col("id").alias("event_id"))
    return correlate.drop_overlapping(bursts, events, late)[0].select("chain_id")


@R.add("k14_correlate_attacks", WITH_T + """
SELECT ip, count(*) AS attacks, round(avg(attack_confidence), 6) AS confidence, arg_min(attack_type, (us, id)) AS attack_type, min(us) AS start_us FROM t WHERE attack_type <> 'safe' GROUP BY ip HAVING count(*) >= 3""")
def k14(spark, d):
    c = correlate.correlate_attacks(tagged(spark, d))
    return c.select("ip", "attacks", F.round("confidence", 6).alias("confidence"), "attack_type", us("start_ts").alias("start_us"))


@R.add("k15_basic_timeline", WITH_E + "SELECT id, us, is_anomaly, severity, coalesce(action, message) AS title FROM entries")
def k15(spark, d):
    return correlate.basic_timeline(entries(spark, d)).select("id", us().alias("us"), "is_anomaly", "severity", "title")


@R.add("k16_correlate", WITH_O + f", {_IPC}, {_COVER}, {_REST}, {_KEYC.format(k='usr', src='rest')}" + """
SELECT kind, count(*) AS chains, sum(events)::BIGINT AS events, count(DISTINCT attack_type) AS types FROM (SELECT 'ip' AS kind, events, attack_type FROM ipc UNION ALL SELECT 'user', events, attack_type FROM usrc) GROUP BY kind""")
def k16(spark, d):
    c = correlate.correlate(entries(spark, d), sqli_seconds=600)["chains"].where("kind IN ('ip', 'user')")
    return c.groupBy("kind").agg(F.count("*").alias("chains"), F.sum("events").alias("events"), F.countDistinct("attack_type").alias("types"))


_ALL_CHAINS = f"""{_IPC}, {_COVER}, {_REST}, {_KEYC.format(k='usr', src='rest')}, {_KILL},
first2 AS (SELECT id FROM cov UNION SELECT id FROM rest WHERE usr IN (SELECT key FROM usrc)),
free AS (SELECT *, list_position(['kill:sql_injection', 'kill:account_takeover', 'kill:privilege_escalation', 'kill:ransomware', 'kill:webshell', 'kill:bruteforce'], chain_id) AS p FROM kill
  WHERE chain_id NOT IN (SELECT chain_id FROM kill WHERE event_id IN (SELECT id FROM first2))),
took AS (SELECT * FROM free WHERE chain_id NOT IN (SELECT b.chain_id FROM free a JOIN free b ON a.event_id = b.event_id AND a.p < b.p)),
m0 AS (SELECT ip, min(us) AS s FROM entries GROUP BY ip),
bu AS (SELECT e.ip, max(e.us) AS end_us FROM entries e JOIN m0 USING (ip) WHERE e.us - m0.s < {60 * SECOND} GROUP BY e.ip HAVING count(*) >= 10),
bk AS (SELECT ip FROM bu WHERE ip NOT IN (SELECT bu.ip FROM bu JOIN entries e ON e.ip = bu.ip AND e.us <= bu.end_us WHERE e.id IN (SELECT id FROM first2 UNION SELECT event_id FROM took))),
chain_kinds AS (SELECT 'ip' AS kind, count(*) AS n FROM ipc UNION ALL SELECT 'user', count(*) FROM usrc UNION ALL SELECT 'kill', count(DISTINCT chain_id) FROM took UNION ALL SELECT 'burst', count(*) FROM bk),
chain_ips AS (SELECT key AS ip FROM ipc UNION SELECT ip FROM rest WHERE usr IN (SELECT key FROM usrc) UNION SELECT ip FROM entries WHERE id IN (SELECT event_id FROM took) UNION SELECT ip FROM bk)"""


@R.add("k16_correlate_kinds", WITH_O + f", {_ALL_CHAINS} SELECT kind, n FROM chain_kinds WHERE n > 0")
def k16e(spark, d):
    """Chains by kind after precedence, kill chains and bursts among them."""
    return correlate.correlate(entries(spark, d), sqli_seconds=600)["chains"].groupBy("kind").agg(F.count("*").alias("n"))


@R.add("k16_correlate_summary", WITH_O + f", {_ALL_CHAINS}" + """
SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'critical') AS critical_alerts, (SELECT sum(n) FROM chain_kinds)::BIGINT AS chains,
  least((SELECT sum(n) FROM chain_kinds) * 15 + count(*) FILTER (severity = 'critical') * 20 + count(*) FILTER (severity = 'high') * 10 + (SELECT count(*) FROM chain_ips) * 5, 100)::BIGINT AS risk_score FROM entries""")
def k16b(spark, d):
    return correlate.correlate(entries(spark, d), sqli_seconds=600)["summary"].select("total_alerts", "critical_alerts", "chains", "risk_score")


@R.add("e12_summary_enhanced", WITH_O + f", {_IPC}" + """,
n AS (SELECT count(*) AS c FROM ipc), i AS (SELECT count(DISTINCT key) AS c FROM ipc)
SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'critical') AS critical_alerts, (SELECT c FROM n) AS chains,
  least((SELECT c FROM n) * 15 + count(*) FILTER (severity = 'critical') * 20 + count(*) FILTER (severity = 'high') * 10 + (SELECT c FROM i) * 5, 100) AS risk_score FROM entries""")
def e12(spark, d):
    e = entries(spark, d)
    chains = correlate.ip_attack_chain(correlate.slim(e))
    return stats.summary_enhanced(e, chains, chains.select("chain_id", "attack_type", F.col("key").alias("ip"))).select("total_alerts", "critical_alerts", "chains", "risk_score")


@R.add("e12_chain_ip_threats", WITH_O + f", {_IPC} SELECT key AS ip, count(*) AS chains, count(DISTINCT attack_type) AS types, count(*) * count(DISTINCT attack_type) AS threat_score FROM ipc GROUP BY key ORDER BY threat_score DESC, ip LIMIT 10")
def e12b(spark, d):
    chains = correlate.ip_attack_chain(correlate.slim(entries(spark, d)))
    return stats.chain_ip_threats(chains.select("chain_id", "attack_type", F.col("key").alias("ip")))


@R.add("k16_correlate_tagged", WITH_T + f", {_IPCHAIN}, {_UPROFILE}" + """
SELECT 'ip_correlation' AS kind, count(*) AS chains, round(avg(confidence), 6)::DOUBLE AS confidence FROM ipchains
UNION ALL SELECT 'user_targeting', count(*), round(avg(0.85), 6)::DOUBLE FROM up WHERE ips >= 3 AND failures >= 5
UNION ALL SELECT 'account_compromise', count(*), round(avg(0.9), 6)::DOUBLE FROM up WHERE failures > 0 AND successes > 0 AND (shared_ips > 0 OR failures > 10)""")
def k16c(spark, d):
    c = correlate.correlate_tagged(tagged(spark, d))["chains"]
    return c.groupBy("kind").agg(F.count("*").alias("chains"), F.round(F.avg("confidence"), 6).alias("confidence"))


@R.add("k16_correlate_windows", _WITH_W + f", {_BFCHAIN}," + """
sp AS (SELECT window_us, ip, count(DISTINCT usr) AS users FROM entries JOIN wins USING (us) WHERE outcome = 'failure' GROUP BY 1, 2 HAVING count(DISTINCT usr) >= 3)
SELECT 'bruteforce' AS attack_type, count(*) AS chains, sum(failures)::BIGINT AS hits, round(avg(least(0.7::DOUBLE + failures / 50, 0.95)), 6) AS confidence FROM bfc HAVING count(*) > 0
UNION ALL SELECT 'password_spray', count(*), sum(users)::BIGINT, round(avg(least(0.7::DOUBLE + users / 50, 0.95)), 6) FROM sp HAVING count(*) > 0""")
def k16d(spark, d):
    chains = correlate.correlate_windows(entries(spark, d), DAY_MINUTES, DAY_MINUTES, 2, 3)["chains"]
    return chains.groupBy("attack_type").agg(F.count("*").alias("chains"), F.sum(F.coalesce("failures", "users")).alias("hits"), F.round(F.avg("confidence"), 6).alias("confidence"))
