"""Catalogue: file-timeline checks, their joins, scores and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracehound.functions import scalars
from tracehound.operators import forensics as fx
from tracehound.operators import stats, windows
from tracehound.plans import views as v
from tracehound.plans.registry import Registry, quoted
from tracehound.rules import dims
from tracehound.rules.weights import CHECK_WEIGHTS, ROUND_DELTAS
from tracehound.schema import micros
from tracehound.sources import sinks

R = Registry()
NOW_YEAR = 2000
DAY_US = 86400 * 1_000_000
us = micros
WITH_F = f"WITH {v.FILES_SQL}"
WITH_FU = f"WITH {v.FILES_SQL}, {v.JOURNAL_SQL}"
WITH_FL = f"WITH {v.FILES_SQL}, {v.LSN_SQL}"
WITH_TL = f"WITH {v.TIMELINE_SQL}"
WITH_TU = f"WITH {v.TIMELINE_SQL}, {v.JOURNAL_SQL}"
VOLUME, INSTALL = "1996-03-01 00:00:00", "1996-06-01 00:00:00"
VOLUME_US, INSTALL_US = 825638400000000, 833587200000000


def ts(text: str):
    return F.to_timestamp(F.lit(text))


def _ind(df, *extra):
    return df.select("record_no", "check_id", "severity", *extra)


# --- joins and order checks -----------------------------------------------------------------------------

_PER_USN = "pu AS (SELECT file_ref AS record_no, count(*) AS usn_rows, min(us) FILTER (reason & 17 <> 0) AS fw, min(us) FILTER (reason & 256 <> 0) AS fc FROM usn GROUP BY 1)"
_PER_LSN = "pl AS (SELECT file_ref & 281474976710655 AS record_no, count(*) AS lsn_rows, min(us) AS fa, max(us) AS la FROM lsn GROUP BY 1)"


@R.add("d10_files_with_journal", WITH_FU + f", {_PER_USN} SELECT record_no, usn_rows, coalesce(fw, -1) AS first_write_us, coalesce(fc, -1) AS first_create_us FROM files LEFT JOIN pu USING (record_no)")
def d10(spark, d):
    j = fx.with_usn(v.file_records(spark, d), v.journal(spark, d))
    return j.select("record_no", "usn_rows", F.coalesce(us("first_write"), F.lit(-1)).alias("first_write_us"), F.coalesce(us("first_create"), F.lit(-1)).alias("first_create_us"))


@R.add("d11_files_with_log", WITH_FL + f", {_PER_LSN} SELECT record_no, lsn_rows, fa AS first_us, la AS last_us FROM files LEFT JOIN pl USING (record_no)")
def d11(spark, d):
    j = fx.with_lsn(v.file_records(spark, d), v.transaction_log(spark, d))
    return j.select("record_no", "lsn_rows", us("first_activity").alias("first_us"), us("last_activity").alias("last_us"))


_BOOTS = """boots AS (SELECT (us // 86400000000) AS day, max(us + 40000000000) AS boot FROM (SELECT epoch_us(l_shipdate) AS us FROM lineitem WHERE l_linenumber = 1) GROUP BY 1)"""


def _boots(spark, d):
    li = v.table(spark, d, "lineitem").where("l_linenumber = 1")
    return li.select(v._shift(F.col("l_shipdate").cast("timestamp"), F.lit(40000)).alias("boot")).distinct()


_BOOT_SQL = WITH_F + f", {_BOOTS}" + """
SELECT record_no, 'before_boot' AS check_id, 'HIGH' AS severity, 'si_modified' AS detail FROM files JOIN boots ON si_m // 86400000000 = day WHERE si_m < boot
UNION ALL SELECT record_no, 'before_boot', 'HIGH', 'fn_modified' FROM files JOIN boots ON fn_m // 86400000000 = day WHERE fn_m < boot"""


@R.add("d13_boot_boundary", _BOOT_SQL)
def d13(spark, d):
    return _ind(fx.boot_bound(v.file_records(spark, d), _boots(spark, d)), "detail")


R.add("m11_boot_bound", _BOOT_SQL)(d13)

_SNAP_SQL = WITH_F + f", {v.SNAPSHOTS_SQL}" + """,
seen AS (SELECT path, max(us) AS seen FROM snap_files JOIN snaps USING (snapshot_id) GROUP BY 1)
SELECT record_no, 'snapshot_gap' AS check_id, 'HIGH' AS severity FROM files LEFT JOIN seen ON filename = path WHERE si_c < (SELECT max(us) FROM snaps) AND (seen IS NULL OR seen <= si_c)"""


@R.add("d14_absent_from_snapshots", _SNAP_SQL)
def d14(spark, d):
    return _ind(fx.snapshot_gap(v.file_records(spark, d), v.snapshots(spark, d), v.snapshot_files(spark, d)))


R.add("m18_snapshot_gap", _SNAP_SQL)(d14)

_PATHS = f"pth AS (SELECT record_id, event_id, us, lower(object_name) AS path, regexp_extract(lower(object_name), '([^\\\\/]*)$', 1) AS name FROM winev)"


@R.add("d15_file_event_paths", f"WITH {v.FILES_SQL}, {v.WINEVENTS_SQL}, {_PATHS}, fn AS (SELECT DISTINCT regexp_extract(filename, '([^\\\\/]*)$', 1) AS name FROM files) SELECT DISTINCT name, path FROM pth WHERE name IN (SELECT name FROM fn)")
def d15(spark, d):
    return fx.file_paths(v.file_records(spark, d), fx.event_paths(v.windows_events(spark, d)))


@R.add("d18_event_paths", f"WITH {v.WINEVENTS_SQL}, {_PATHS} SELECT record_id, event_id, path, name FROM pth")
def d18(spark, d):
    return fx.event_paths(v.windows_events(spark, d)).select("record_id", "event_id", "path", "name")


_NOW_TS, _NOW_US = "1998-07-20 00:00:00", 900892800000000
_TP = "tp AS (SELECT *, epoch_us(strptime(created, '%Y-%m-%d %H:%M:%S')) AS c, epoch_us(strptime(modified, '%Y-%m-%d %H:%M:%S')) AS m, regexp_extract(lower(filename), '([^\\\\/]*)$', 1) AS name FROM timeline)"
_PF_SQL = WITH_TL + f", {v.PREFETCH_SQL}, {_TP}" + f"""
SELECT filename, 'prefetch_missing' AS rule_id FROM tp WHERE ends_with(lower(filename), '.exe') AND floor(({_NOW_US} - c) / {DAY_US}::DOUBLE) > 0 AND floor(({_NOW_US} - c) / {DAY_US}::DOUBLE) < 30
  AND upper(regexp_extract(name, '^([^.\\-]+)', 1)) NOT IN (SELECT upper(regexp_extract(pf.name, '^([^.\\-]+)', 1)) FROM pf)"""


@R.add("d16_exe_without_prefetch", _PF_SQL)
def d16(spark, d):
    return fx.prefetch_gap(v.file_timeline(spark, d), v.prefetch(spark, d), ts(_NOW_TS)).select("filename", "rule_id")


R.add("m26_prefetch_gap", _PF_SQL)(d16)

_PRES_SQL = WITH_TU + f", {v.WINEVENTS_SQL}, {_PATHS}, {_TP}" + """,
a AS (SELECT DISTINCT name, 'Timeline' AS s FROM tp UNION SELECT DISTINCT file_name, 'USN' FROM usn UNION SELECT DISTINCT name, 'Events' FROM pth)
SELECT name, count(*) AS sources FROM a GROUP BY 1 HAVING count(*) >= 3"""


def _timeline_names(spark, d):
    """Base names of the timeline, dealt by name: tasks of its join end here and do not hold a table of names as well."""
    return v.file_timeline(spark, d).select(fx.base_name(F.col("filename")).alias("name")).repartition("name")


@R.add("d17_presence", _PRES_SQL)
def d17(spark, d):
    t = _timeline_names(spark, d)
    u = v.journal(spark, d).select(F.col("file_name").alias("name"))
    e = fx.event_paths(v.windows_events(spark, d)).select("name")
    return fx.presence({"Timeline": t, "USN": u, "Events": e}).select("name", "sources")


R.add("m26_presence", _PRES_SQL)(d17)

_PRES_WHOLE_SQL = WITH_TU + f", {v.WINEVENTS_SQL}, {_PATHS}, {_TP}" + """,
a AS (SELECT DISTINCT name, 'Timeline' AS s FROM tp UNION SELECT DISTINCT file_name, 'USN' FROM usn UNION SELECT DISTINCT name, 'Events' FROM pth)
SELECT name, count(*) AS sources FROM a GROUP BY 1 HAVING count(*) >= 3"""


@R.add("d17_presence_whole", _PRES_WHOLE_SQL)
def d17_whole(spark, d):
    t = _timeline_names(spark, d)
    e = fx.event_paths(v.windows_events(spark, d)).select("name")
    return fx.presence({"Timeline": t, "USN": v.journal(spark, d).select(F.col("file_name").alias("name")), "Events": e}).select("name", "sources")


@R.add("d12_volume_scalar", WITH_F + ", b AS (SELECT min(si_c) + 30000000000000 AS v FROM files) SELECT record_no, 'before_volume' AS flag FROM files WHERE si_c < (SELECT v FROM b)")
def d12(spark, d):
    f = v.file_records(spark, d)
    bound = f.agg((F.min(us("si_created")) + 30000000000000).alias("v")).scalar()
    return f.where(us("si_created") < bound).select("record_no", F.lit("before_volume").alias("flag"))


@R.add("f9_lsn_order", f"WITH {v.LSN_SQL}, x AS (SELECT file_ref & 281474976710655 AS record_no, lsn, us, lag(lsn) OVER w AS prev_lsn, lag(us) OVER w AS prev_us FROM lsn WINDOW w AS (PARTITION BY file_ref & 281474976710655 ORDER BY lsn, us)) SELECT record_no, prev_lsn, prev_us, lsn, us FROM x WHERE us < prev_us")
def f9(spark, d):
    return windows.lsn_order(v.transaction_log(spark, d), 1 << 20)


@R.add("f10_lsn_gaps", f"WITH {v.LSN_SQL}, x AS (SELECT partition::BIGINT AS partition, lsn, lag(lsn) OVER (PARTITION BY partition ORDER BY lsn) AS p FROM (SELECT DISTINCT partition, lsn FROM lsn WHERE lsn > 0)) SELECT partition, p AS from_lsn, lsn AS to_lsn, lsn - p AS gap_size FROM x WHERE lsn - p > 1000000")
def f10(spark, d):
    return windows.lsn_gaps(v.transaction_log(spark, d), 1_000_000, 1 << 26).withColumn("partition", F.col("partition").cast("bigint"))


_CLOCK = f"WITH {v.WINEVENTS_SQL}, x AS (SELECT channel, record_id, us, lag(us) OVER (PARTITION BY channel ORDER BY record_id) AS prev_us FROM winev) SELECT channel, record_id, prev_us, us FROM x WHERE us < prev_us"


@R.add("f11_clock_rollback", _CLOCK)
def f11(spark, d):
    return windows.clock_rollback(v.windows_events(spark, d), 500).drop("rollback_seconds")


@R.add("h8_reason_names", f"WITH {v.JOURNAL_SQL} SELECT usn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN reason & {b} <> 0 THEN '{n}' END" for b, n in dims.USN_REASONS.items()) + "], lambda x: x IS NOT NULL), '|') AS names FROM usn")
def h8(spark, d):
    return v.journal(spark, d).select("usn", F.array_join(scalars.reason_names(F.col("reason")), "|").alias("names"))


# --- checks on records ----------------------------------------------------------------------------------


def _mismatch(year: int) -> str:
    cut = f"year(make_timestamp({{c}})) > {year + 1}"
    parts = [f"SELECT record_no, '{n}_mismatch' AS check_id, CASE WHEN abs({a} - {b}) > {DAY_US} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, abs({a} - {b}) / 1000000::DOUBLE AS seconds FROM files WHERE abs({a} - {b}) > 1000000" for n, a, b in (("created", "si_c", "fn_c"), ("modified", "si_m", "fn_m"))]
    parts += [f"SELECT record_no, 'future_{n}', 'CRITICAL', NULL FROM files WHERE {cut.format(c=c)}" for n, c in (("created", "si_c"), ("modified", "si_m"), ("accessed", "si_a"))]
    return " UNION ALL ".join(parts)


@R.add("m1_si_fn_mismatch", WITH_F + " " + _mismatch(NOW_YEAR))
def m1(spark, d):
    return _ind(fx.si_fn_mismatch(v.file_records(spark, d), NOW_YEAR), "seconds")


_ROUND = "CASE " + " ".join(f"WHEN abs(dd - {r}) < 60 THEN {r}" for r in ROUND_DELTAS) + " END"
_DELTAS = "dl AS (SELECT record_no, 'created' AS k, abs(si_c - fn_c) / 1000000::DOUBLE AS dd FROM files UNION ALL SELECT record_no, 'modified', abs(si_m - fn_m) / 1000000::DOUBLE FROM files)"


@R.add("m2_round_delta", WITH_F + f", {_DELTAS} SELECT record_no, k || CASE WHEN {_ROUND} IS NOT NULL THEN '_round_delta' ELSE '_large_delta' END AS check_id, 'HIGH' AS severity, {_ROUND}::VARCHAR AS detail FROM dl WHERE dd > 1 AND ({_ROUND} IS NOT NULL OR dd > 2592000)")
def m2(spark, d):
    return _ind(fx.round_delta(v.file_records(spark, d)), "detail")


@R.add("m3_batch_delta", WITH_F + f", {_DELTAS}, b AS (SELECT {_ROUND}::BIGINT AS delta, count(*) AS n FROM dl WHERE dd > 1 GROUP BY 1) SELECT delta, n FROM b WHERE delta IS NOT NULL AND n >= 3 ORDER BY n DESC, delta LIMIT 1")
def m3(spark, d):
    return fx.batch_delta(v.file_records(spark, d)).select(F.col("delta").cast("bigint").alias("delta"), "n")


_CAUS = f"""SELECT record_no, 'usn_absent' AS check_id, 'MEDIUM' AS severity FROM fu WHERE usn_rows IS NULL UNION ALL SELECT record_no, 'si_modified_before_write', 'CRITICAL' FROM fu WHERE si_m < fw UNION ALL SELECT record_no, 'fn_modified_before_write', 'CRITICAL' FROM fu WHERE fn_m < fw"""
_FU = f"{_PER_USN}, fu AS (SELECT * FROM files LEFT JOIN pu USING (record_no))"


@R.add("m4_usn_causality", WITH_FU + f", {_FU} {_CAUS}")
def m4(spark, d):
    return _ind(fx.usn_causality(v.file_records(spark, d), v.journal(spark, d)))


@R.add("m5_usn_create", WITH_FU + f""", {_FU},
r AS (SELECT record_no, CASE WHEN fc IS NULL THEN 'missing' WHEN abs(fc - si_c) > {DAY_US} THEN 'si_differs' WHEN abs(fc - fn_c) > {DAY_US} THEN 'fn_differs' WHEN si_c < fc THEN 'before_create' ELSE 'consistent' END AS reason FROM fu)
SELECT record_no, reason, reason <> 'consistent' AS is_suspicious, CASE reason WHEN 'before_create' THEN 'CRITICAL' WHEN 'consistent' THEN 'LOW' ELSE 'HIGH' END AS severity FROM r""")
def m5(spark, d):
    return fx.usn_create(v.file_records(spark, d), v.journal(spark, d)).select("record_no", "reason", "is_suspicious", "severity")


@R.add("m6_usn_events", f"WITH {v.JOURNAL_SQL} SELECT 'create' AS kind, usn FROM usn WHERE reason & 256 <> 0 UNION ALL SELECT 'delete', usn FROM usn WHERE reason & 512 <> 0 UNION ALL SELECT 'rename', usn FROM usn WHERE reason & 12288 <> 0")
def m6(spark, d):
    u = v.journal(spark, d)
    parts = [fx.usn_events(u, k).select(F.lit(k).alias("kind"), "usn") for k in ("create", "delete", "rename")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FALLS = "fl AS (SELECT record_no, count(*) AS falls FROM (SELECT file_ref & 281474976710655 AS record_no, us, lag(us) OVER (PARTITION BY file_ref & 281474976710655 ORDER BY lsn, us) AS p FROM lsn) WHERE us < p GROUP BY 1)"
_LCHK = f"""SELECT record_no, 'lsn_order' AS check_id, 'HIGH' AS severity FROM files JOIN fl USING (record_no) UNION ALL SELECT record_no, 'si_created_before_log', 'HIGH' FROM files JOIN pl USING (record_no) WHERE fa - si_c > {DAY_US}
UNION ALL SELECT record_no, 'si_modified_before_log', 'HIGH' FROM files JOIN pl USING (record_no) WHERE fa - si_m > {DAY_US}"""


@R.add("m7_lsn_checks", WITH_FL + f", {_PER_LSN}, {_FALLS} {_LCHK}")
def m7(spark, d):
    return _ind(fx.lsn_checks(v.file_records(spark, d), v.transaction_log(spark, d)))


@R.add("m8_lsn_profile", f"WITH {v.LSN_SQL}, x AS (SELECT lsn - lag(lsn) OVER (PARTITION BY partition ORDER BY lsn) AS g FROM (SELECT DISTINCT partition, lsn FROM lsn)) SELECT count(*) AS total_records, "
       + ", ".join(f"count(*) FILTER (op_code IN ({', '.join(map(str, c))})) AS {k}" for k, c in dims.LSN_VIEWS.items()) + ", (SELECT count(*) FROM x WHERE g > 1000000) AS gaps FROM lsn")
def m8(spark, d):
    return fx.lsn_profile(v.transaction_log(spark, d))


@R.add("m8_lsn_renames", f"WITH {v.LSN_SQL} SELECT lsn, op_code::BIGINT AS op_code FROM lsn WHERE op_code = 6")
def m8b(spark, d):
    return fx.lsn_view(v.transaction_log(spark, d), "rename").select("lsn", F.col("op_code").cast("bigint").alias("op_code"))


@R.add("m9_volume_bound", WITH_F + f" SELECT record_no, 'si_created_before_volume' AS check_id, 'CRITICAL' AS severity FROM files WHERE si_c < {VOLUME_US} UNION ALL SELECT record_no, 'fn_created_before_volume', 'CRITICAL' FROM files WHERE fn_c < {VOLUME_US}")
def m9(spark, d):
    return _ind(fx.volume_bound(v.file_records(spark, d), ts(VOLUME)))


@R.add("m9_timeline_volume", WITH_TL + f", {_TP}, b AS (SELECT min(c) AS vol FROM tp WHERE contains(filename, 'file201.')) SELECT filename, 'volume_boundary_violation' AS rule_id FROM tp WHERE NOT contains(filename, 'file201.') AND floor(((SELECT vol FROM b) - c) / {DAY_US}::DOUBLE) > 30")
def m9b(spark, d):
    t = v.file_timeline(spark, d)
    named = F.when(F.contains("filename", F.lit("file201.")), F.concat(F.lit("$boot"), "filename")).otherwise(F.col("filename"))
    return fx.timeline_volume_bound(t.withColumn("filename", named)).select("filename", "rule_id")


_SYS = r"regexp_matches(filename, '\\windows\\|\\program files|\\system32\\|\\programdata\\')"


@R.add("m10_install_bound", WITH_F + f" SELECT record_no, 'si_created_before_install' AS check_id, CASE WHEN {_SYS} THEN 'LOW' ELSE 'CRITICAL' END AS severity FROM files WHERE si_c < {INSTALL_US} UNION ALL SELECT record_no, 'fn_created_before_install', CASE WHEN {_SYS} THEN 'LOW' ELSE 'CRITICAL' END FROM files WHERE fn_c < {INSTALL_US}")
def m10(spark, d):
    return _ind(fx.install_bound(v.file_records(spark, d), ts(INSTALL)))


@R.add("m12_time_changes", f"WITH {v.WINEVENTS_SQL} SELECT count(*) AS events, 'HIGH' AS severity FROM winev WHERE event_id IN (4616, 1) HAVING count(*) > 0")
def m12(spark, d):
    return fx.time_changes(v.windows_events(spark, d)).select("events", "severity")


R.add("m12_clock_rollback", _CLOCK)(f11)

_DUP = "f2 AS (SELECT * REPLACE (record_no // 4 AS record_no) FROM files), tp2 AS (SELECT partition, record_no, max(sequence_no) AS top, count(*) AS c FROM f2 GROUP BY 1, 2)"


@R.add("m13_sequence_checks", WITH_F + f", {_DUP}" + f""", j AS (SELECT * FROM f2 JOIN tp2 USING (partition, record_no))
SELECT filename, 'sequence_jump' AS check_id FROM j WHERE c > 1 AND top > sequence_no + 10 UNION ALL SELECT filename, 'old_timestamp_new_seq' FROM j WHERE year(make_timestamp(si_c)) < 2000
UNION ALL SELECT filename, 'seq_vs_volume' FROM j WHERE floor((915148800000000 - si_c) / {DAY_US}::DOUBLE) / 365 > 1""")
def m13(spark, d):
    f = v.file_records(spark, d).withColumn("record_no", F.floor(F.col("record_no") / 4).cast("bigint"))
    return fx.sequence_checks(f, ts("1999-01-01 00:00:00")).select("filename", "check_id")


@R.add("m14_second_cluster", WITH_F + ", t AS (SELECT unnest([si_c, si_m, fn_c, fn_m]) AS t FROM files) SELECT t // 1000000 * 1000000 AS second_us, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, 1 LIMIT 1")
def m14(spark, d):
    return fx.second_cluster(v.file_records(spark, d)).select(us("second").alias("second_us"), "n")


@R.add("m15_time_concentration", WITH_F + ", f2 AS (SELECT CASE WHEN record_no % 7 < 4 THEN 852076800000000 ELSE si_c END AS c FROM files), g AS (SELECT c // 60000000 AS m, count(*) AS n FROM f2 GROUP BY 1 ORDER BY n DESC LIMIT 1) SELECT 'minute' AS unit, n, round(n / (SELECT count(*) FROM f2)::DOUBLE, 6) AS ratio, 'MEDIUM' AS severity FROM g WHERE n / (SELECT count(*) FROM f2)::DOUBLE > 0.5")
def m15(spark, d):
    f = v.file_records(spark, d).withColumn("si_created", F.when(F.col("record_no") % 7 < 4, ts("1997-01-01 00:00:00")).otherwise(F.col("si_created")))
    return fx.time_concentration(f).select("unit", "n", F.round("ratio", 6).alias("ratio"), "severity")


@R.add("m16_dir_cluster", WITH_TL + ", g AS (SELECT left(created, 16) AS minute, count(*) AS files, count(DISTINCT nullif(regexp_extract(filename, '^(.*)/[^/]*$', 1), '')) AS dirs FROM timeline GROUP BY 1) SELECT minute, files, dirs FROM g WHERE files > 10 AND dirs > 5")
def m16(spark, d):
    return fx.dir_cluster(v.file_timeline(spark, d))


@R.add("m17_subsecond", WITH_F + ", f2 AS (SELECT unnest([si_c + CASE WHEN record_no % 9 = 0 THEN 250000 ELSE 0 END, si_m, fn_c, fn_m]) AS t FROM files), z AS (SELECT count(*) FILTER (t % 1000000 = 0) AS n, count(*) AS c FROM f2) SELECT CASE WHEN n / c::DOUBLE > 0.95 THEN 'all_zero_microseconds' ELSE 'mostly_zero_microseconds' END AS check_id, n, round(n / c::DOUBLE, 6) AS ratio FROM z WHERE n / c::DOUBLE > 0.8")
def m17(spark, d):
    shifted = F.timestamp_micros(us("si_created") + F.when(F.col("record_no") % 9 == 0, 250000).otherwise(0))
    f = v.file_records(spark, d).withColumn("si_created", shifted)
    return fx.subsecond(f).select("check_id", "n", F.round("ratio", 6).alias("ratio"))


@R.add("m19_journal_integrity", f"WITH {v.JOURNAL_SQL}, {v.LSN_SQL}, w AS (SELECT * FROM usn WHERE us < (SELECT min(us) FROM usn) + 400000000000), s AS (SELECT * FROM lsn WHERE lsn < 1000000) "
       "SELECT 'usn_recent_start' AS check_id, count(*) AS n FROM w HAVING count(*) > 100 UNION ALL SELECT 'logfile_small', count(*) FROM s HAVING count(*) < 100 AND count(*) > 0 UNION ALL SELECT 'no_shadow_copies', 0")
def m19(spark, d):
    u, l = v.journal(spark, d), v.transaction_log(spark, d)
    start = u.agg((F.min(us("ts")) + 400000000000).alias("v")).scalar()
    none = v.snapshots(spark, d).where("snapshot_id < 0")
    return fx.journal_integrity(u.where(us("ts") < start), l.where("lsn < 1000000"), none).select("check_id", "n")


# --- checks on the text timeline ------------------------------------------------------------------------

_RULES = """SELECT filename, 'future_timestamp' AS rule_id, 'CRITICAL' AS severity, 100::BIGINT AS score FROM tp WHERE year(make_timestamp(c)) > 2001
UNION ALL SELECT filename, 'zero_timestamp', 'HIGH', 75 FROM tp WHERE starts_with(created, '1601-01-01') AND NOT contains(type, '*') UNION ALL SELECT filename, 'ancient_timestamp', 'MEDIUM', 50 FROM tp WHERE year(make_timestamp(c)) < 1990"""


@R.add("m20_timeline_rules", WITH_TL + f", {_TP} {_RULES}")
def m20(spark, d):
    return fx.timeline_rules(v.file_timeline(spark, d), NOW_YEAR).select("filename", "rule_id", "severity", F.col("score").cast("bigint").alias("score"))


_ORDER = f"""un AS (SELECT file_name AS name, bool_or(reason & 256 <> 0) AS hc, bool_or(reason & 51 <> 0) AS hw, min(us) AS e FROM usn GROUP BY 1),
oj AS (SELECT *, floor((c - m) / {DAY_US}::DOUBLE) AS days FROM tp LEFT JOIN un USING (name)),
oc AS (SELECT filename, CASE WHEN NOT (m < c) OR hc IS NULL OR (hc AND NOT hw) THEN NULL WHEN hw AND e > c AND e < m THEN 'writes_between' WHEN hw AND days > 365 THEN 'old_with_activity' WHEN days > 365 THEN 'verify' END AS x FROM oj)"""
_ORDER_ROWS = "SELECT filename, 'LOW' AS severity, 25::BIGINT AS score, x AS expected_value FROM oc WHERE x IS NOT NULL UNION ALL SELECT filename, 'HIGH', 75, 'zero' FROM tp WHERE starts_with(created, '1601-01-01') AND NOT contains(type, '*')"


@R.add("m21_order_anomalies", WITH_TU + f", {_TP}, {_ORDER} {_ORDER_ROWS}")
def m21(spark, d):
    return fx.order_anomalies(v.file_timeline(spark, d), v.journal(spark, d)).select("filename", "severity", F.col("score").cast("bigint").alias("score"), "expected_value")


@R.add("m22_possibly_copied", WITH_TL + f", {_TP} SELECT DISTINCT filename, created, modified FROM tp WHERE m < c")
def m22(spark, d):
    """The rule is for images without a journal; one with rows gives none (tests)."""
    absent = spark.createDataFrame([], "file_name STRING")
    return fx.possibly_copied(v.file_timeline(spark, d), absent)


@R.add("m23_usn_missing", WITH_TU + f", {_TP} SELECT filename, 'usn_missing' AS rule_id FROM tp WHERE year(make_timestamp(c)) < 2015 AND name NOT IN (SELECT file_name FROM usn)")
def m23(spark, d):
    return fx.usn_missing(v.file_timeline(spark, d), v.journal(spark, d)).select("filename", "rule_id")


@R.add("m23_usn_missing_whole", WITH_TU + f", {_TP} SELECT filename, 'usn_missing' AS rule_id FROM tp WHERE year(make_timestamp(c)) < 2015 AND name NOT IN (SELECT file_name FROM usn)")
def m23_whole(spark, d):
    return fx.usn_missing(v.file_timeline(spark, d), v.journal(spark, d)).select("filename", "rule_id")


_EVB = f"""bd AS (SELECT min(us) - 26 * 365 * {DAY_US} AS a, max(us) - 26 * 365 * {DAY_US} AS b FROM winev)"""


@R.add("m24_event_bounds", WITH_TL + f", {v.WINEVENTS_SQL}, {_TP}, {_EVB}" + f"""
SELECT filename, 'si_after_event_logs' AS rule_id FROM tp, bd WHERE floor((c - b) / {DAY_US}::DOUBLE) > 1 UNION ALL SELECT filename, 'si_before_event_logs' FROM tp, bd WHERE floor((a - c) / {DAY_US}::DOUBLE) > 1825""")
def m24(spark, d):
    ev = v.windows_events(spark, d).withColumn("ts", F.timestamp_micros(us("ts") - F.lit(26 * 365 * DAY_US)))
    return fx.event_bounds_check(v.file_timeline(spark, d), ev).select("filename", "rule_id")


@R.add("m25_exact_delta", WITH_TL + f", {_TP} SELECT filename, abs(c - m) / 1000000::DOUBLE AS seconds FROM tp WHERE abs(c - m) IN (3600000000, 86400000000, 31536000000000)")
def m25(spark, d):
    return fx.exact_delta(v.file_timeline(spark, d)).select("filename", F.col("time_diff_seconds").alias("seconds"))


@R.add("m29_timeline_gap", WITH_TL + f", {_TP} SELECT filename, max(abs(floor((c - m) / {DAY_US}::DOUBLE)))::BIGINT AS gap_days FROM tp WHERE abs(floor((c - m) / {DAY_US}::DOUBLE)) > 365 GROUP BY 1")
def m29(spark, d):
    return fx.timeline_gap(v.file_timeline(spark, d)).select("filename", "gap_days")


# --- events and scores ----------------------------------------------------------------------------------


def _old_events(spark, d):
    """The event log moved back to the years of the files."""
    return v.windows_events(spark, d).withColumn("ts", F.timestamp_micros(us("ts") - F.lit(27 * 365 * DAY_US)))


_KIND = "CASE " + " ".join(f"WHEN event_id IN ({', '.join(map(str, ids))}) THEN '{k}'" for k, ids in dims.FILE_EVENT_KINDS.items()) + " END"
_FEV = f"""pk AS (SELECT *, us - 27 * 365 * {DAY_US} AS us2, {_KIND} AS kind FROM pth),
fev AS (SELECT f.record_no, pk.kind, count(*) AS events, min(us2) AS first_us, (min(f.si_c) - min(us2)) / 1000000::DOUBLE AS seconds FROM files f JOIN pk ON regexp_extract(f.filename, '([^\\\\/]*)$', 1) = pk.name WHERE kind IS NOT NULL GROUP BY 1, 2)"""


@R.add("m28_file_events", f"WITH {v.FILES_SQL}, {v.WINEVENTS_SQL}, {_PATHS}, {_FEV} SELECT record_no, kind, events, first_us, CASE WHEN seconds > 300 THEN 'HIGH' ELSE 'INFO' END AS severity FROM fev")
def m28(spark, d):
    return fx.file_events(v.file_records(spark, d), _old_events(spark, d)).select("record_no", "kind", "events", us("first_event").alias("first_us"), "severity")


_LAYERS = f"""bnd AS (SELECT max(us) FILTER (channel = 'Security') - 27 * 365 * {DAY_US} AS sec, max(us) FILTER (channel = 'System') - 27 * 365 * {DAY_US} AS sysm FROM winev),
ly AS (SELECT f.record_no, f.partition::BIGINT AS partition,
 CASE WHEN abs(si_c - fn_c) > {DAY_US} OR abs(si_m - fn_m) > {DAY_US} THEN 30 WHEN abs(si_c - fn_c) > 1000000 OR abs(si_m - fn_m) > 1000000 THEN 15 ELSE 0 END::DOUBLE AS layer1,
 CASE WHEN fc IS NULL THEN 0 WHEN si_c < fc THEN 30 WHEN abs(si_c - fc) > {DAY_US} THEN 30 WHEN abs(si_c - fc) > 60000000 THEN 15 ELSE 0 END::DOUBLE AS layer2,
 CASE WHEN fa - si_c > 0 THEN CASE WHEN fa - si_c > {DAY_US} THEN 20 ELSE 0 END WHEN si_c - fa > 7 * {DAY_US} THEN 10 ELSE 0 END::DOUBLE AS layer3, 0::DOUBLE AS layer4,
 CASE WHEN f.record_no IN (SELECT record_no FROM fev WHERE seconds > 300) THEN 15 WHEN si_c - sec > {DAY_US} THEN 15 WHEN si_c - sysm > {DAY_US} THEN 7.5 ELSE 0 END::DOUBLE AS layer5
 FROM files f LEFT JOIN pu USING (record_no) LEFT JOIN pl USING (record_no), bnd),
sc AS (SELECT *, layer1 + layer2 + layer3 + layer4 + layer5 AS score FROM ly),
fin AS (SELECT *, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM sc)"""
WITH_LAYERS = f"WITH {v.FILES_SQL}, {v.JOURNAL_SQL}, {v.LSN_SQL}, {v.WINEVENTS_SQL}, {_PATHS}, {_FEV}, {_PER_USN}, {_PER_LSN}, {_LAYERS}"


def _layered(spark, d):
    return fx.layered_score(v.file_records(spark, d), v.journal(spark, d), v.transaction_log(spark, d), _old_events(spark, d), NOW_YEAR)


@R.add("m27_layered_score", WITH_LAYERS + " SELECT record_no, layer1, layer2, layer3, layer5, score, severity, score >= 25 AS is_suspicious FROM fin")
def m27(spark, d):
    return _layered(spark, d).select("record_no", "layer1", "layer2", "layer3", "layer5", "score", "severity", "is_suspicious")


@R.add("e18_finding_summary", WITH_LAYERS + " SELECT partition, severity, count(*) AS n, count(*) FILTER (score >= 25) AS suspicious FROM fin GROUP BY ROLLUP (partition, severity)")
def e18(spark, d):
    f = _layered(spark, d).withColumn("partition", F.col("partition").cast("string"))
    return stats.finding_summary(f)


R.sql["e18_finding_summary"] = R.sql["e18_finding_summary"].replace("SELECT partition, severity, count(*) AS n", "SELECT partition::VARCHAR AS partition, severity, count(*) AS n")

_VOTES = f"""vt AS (SELECT record_no, max(CASE WHEN severity = 'HIGH' THEN 2 ELSE 1 END) AS votes FROM ({_mismatch(9999)}) GROUP BY 1
 UNION ALL SELECT DISTINCT record_no, 2 FROM ({_CAUS}) WHERE check_id <> 'usn_absent' UNION ALL SELECT DISTINCT record_no, 2 FROM ({_LCHK})
 UNION ALL SELECT record_no, 2 FROM files WHERE si_c < {VOLUME_US} UNION ALL SELECT record_no, 2 FROM files WHERE si_c < {INSTALL_US})"""


@R.add("m30_vote", f"WITH {v.FILES_SQL}, {v.JOURNAL_SQL}, {v.LSN_SQL}, {_FU}, {_PER_LSN}, {_FALLS}, {_VOTES} SELECT record_no, sum(votes)::BIGINT AS votes, CASE WHEN sum(votes) >= 6 THEN 'CRITICAL' WHEN sum(votes) >= 4 THEN 'HIGH' WHEN sum(votes) >= 2 THEN 'MEDIUM' ELSE 'INFO' END AS severity FROM vt GROUP BY 1")
def m30(spark, d):
    i = fx.contradictions(v.file_records(spark, d), v.journal(spark, d), v.transaction_log(spark, d), ts(VOLUME), ts(INSTALL))
    return fx.vote(i).select("record_no", "votes", "severity")


_W = "CASE check_no " + " ".join(f"WHEN {k} THEN {w}" for k, w in CHECK_WEIGHTS.items()) + " ELSE 1.0 END::DOUBLE"


@R.add("m31_weighted_score", WITH_FU + f", {_FU}" + f""",
i AS (SELECT record_no, 1 AS check_no, severity, CASE WHEN starts_with(check_id, 'future') THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence FROM ({_mismatch(NOW_YEAR)}) UNION ALL SELECT record_no, 2, severity, CASE WHEN severity = 'MEDIUM' THEN 0.5 ELSE 0.95 END FROM ({_CAUS})),
g AS (SELECT record_no, count(*) AS indicators, least(100.0, sum(CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 50 WHEN 'LOW' THEN 25 ELSE 0 END * confidence * {_W}) / sum({_W} * 100) * 100) AS score, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h FROM i GROUP BY 1)
SELECT record_no, indicators, round(score, 4)::DOUBLE AS score, CASE WHEN c > 0 OR score > 75 THEN 'CRITICAL' WHEN h > 0 OR score > 50 THEN 'HIGH' WHEN score > 25 THEN 'MEDIUM' ELSE 'INFO' END AS severity FROM g""")
def m31(spark, d):
    f = v.file_records(spark, d)
    i = fx.si_fn_mismatch(f, NOW_YEAR).unionByName(fx.usn_causality(f, v.journal(spark, d)))
    return fx.weighted_score(i).select("record_no", "indicators", F.round("score", 4).alias("score"), "severity")


_ADD = f"ad AS (SELECT filename, severity, score FROM ({_RULES}) UNION ALL SELECT filename, severity, score FROM ({_ORDER_ROWS}))"


@R.add("m32_additive_score", WITH_TU + f", {_TP}, {_ORDER}, {_ADD} SELECT filename, sum(score)::BIGINT AS score, CASE max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, count(*) AS indicators FROM ad GROUP BY 1")
def m32(spark, d):
    t = v.file_timeline(spark, d)
    return fx.additive_score(fx.timeline_rules(t, NOW_YEAR).unionByName(fx.order_anomalies(t, v.journal(spark, d))))


def _listing(spark, d):
    """Artifact listings over the documents: the listing kind and some telling words by line number."""
    kinds = ["timeline", "usn_journal", "mft", "logs", "registry", "shadow_copies", "hidden_structures"]
    words = ["", "vssadmin", "$OrphanFiles", "log cleared", "ccleaner", "No shadow copy", "a:Zone.Identifier", "00-00-0000", "2035-01-01", "-/r", "No USN journal", "$Extend", "2020-01-01 01:02:03 2020-01-01 01:02:03 a b c"]
    dl = v.doc_lines(spark, d)
    pick = lambda values, sel: F.get(F.array(*[F.lit(x) for x in values]), sel.cast("int"))
    return dl.select(
        (F.col("source").cast("bigint") % 3).alias("partition"), pick(kinds, F.col("source").cast("bigint") % len(kinds)).alias("listing"),
        F.concat_ws(" ", "line", pick(words, (F.col("line_no") + F.col("source").cast("bigint")) % len(words))).alias("line"))


_KINDS = "['timeline', 'usn_journal', 'mft', 'logs', 'registry', 'shadow_copies', 'hidden_structures']"
_WORDS = "['', 'vssadmin', '$OrphanFiles', 'log cleared', 'ccleaner', 'No shadow copy', 'a:Zone.Identifier', '00-00-0000', '2035-01-01', '-/r', 'No USN journal', '$Extend', '2020-01-01 01:02:03 2020-01-01 01:02:03 a b c']"
_LST = f"WITH {v.DOC_LINES_SQL}, lst AS (SELECT source::BIGINT % 3 AS partition, {_KINDS}[1 + source::BIGINT % 7] AS listing, line || ' ' || {_WORDS}[1 + (line_no + source::BIGINT) % 13] AS line FROM doc_lines)"
_EVID = "ev0 AS (" + " UNION ALL ".join(
    f"SELECT partition, '{k}' AS kind, '{t}' AS type, '{s}' AS severity FROM lst WHERE listing = '{l}' AND regexp_matches(line, {quoted(p)})" for k, l, t, s, p in dims.EVIDENCE
) + " UNION ALL SELECT partition, 'timestomping', 'future_date', 'high' FROM lst WHERE listing = 'timeline' AND len(list_filter(regexp_extract_all(line, '(\\d{4})-(\\d{2})-(\\d{2})', 1), lambda y: y::INTEGER > 2001)) > 0"
_EVID += " UNION ALL SELECT partition, 'timestomping', 'identical_times', 'medium' FROM (SELECT partition, list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '') AS ws FROM lst WHERE listing = 'timeline') WHERE len(ws) >= 6 AND len(list_filter(ws, lambda w: regexp_matches(w, '^(\\d{4}-\\d{2}-\\d{2}|\\d{2}:\\d{2}:\\d{2})'))) >= 4 AND list_filter(ws, lambda w: regexp_matches(w, '^(\\d{4}-\\d{2}-\\d{2}|\\d{2}:\\d{2}:\\d{2})'))[1:2] = list_filter(ws, lambda w: regexp_matches(w, '^(\\d{4}-\\d{2}-\\d{2}|\\d{2}:\\d{2}:\\d{2})'))[3:4])"
_ABSENT = """ab AS (SELECT partition, bool_or(listing = 'shadow_copies' AND contains(line, '$Extend')) AND NOT bool_or(listing = 'shadow_copies' AND contains(line, 'System Volume Information')) AS a,
 bool_or(listing = 'logs') AND NOT bool_or(listing = 'logs' AND contains(lower(line), '.evtx')) AS b, bool_or(listing = 'usn_journal') AND NOT bool_or(listing = 'usn_journal' AND trim(line) <> '') AS c FROM lst GROUP BY 1),
ev1 AS (SELECT * FROM ev0 UNION ALL SELECT partition, 'shadow_copy', 'volume_information_missing', 'high' FROM ab WHERE a UNION ALL SELECT partition, 'log_clearing', 'no_event_logs', 'high' FROM ab WHERE b UNION ALL SELECT partition, 'journal', 'empty', 'high' FROM ab WHERE c)"""


@R.add("m33_evidence_scan", f"{_LST}, {_EVID}, {_ABSENT} SELECT partition, kind, type, severity, count(*) AS hits FROM ev1 GROUP BY ALL")
def m33(spark, d):
    return fx.evidence_scan(_listing(spark, d), NOW_YEAR)


@R.add("e17_indicator_summary", f"{_LST}, {_EVID} SELECT kind, count(*) AS n, (SELECT count(*) FROM ev0) AS total, CASE WHEN (SELECT count(*) FROM ev0) = 0 THEN 'LOW' WHEN (SELECT count(*) FROM ev0) < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM ev0 GROUP BY 1")
def e17(spark, d):
    return stats.indicator_summary(fx.evidence_rows(_listing(spark, d), NOW_YEAR))


_LOGP = "lp AS (SELECT CASE page_id % 5 WHEN 0 THEN 'C:\\Windows\\System32\\winevt\\Logs\\S' || page_id || '.evtx' WHEN 1 THEN '/var/log/app' || page_id WHEN 2 THEN 'C:\\Windows\\Temp\\setup.log' WHEN 3 THEN '/home/u/syslog' ELSE 'C:\\Windows\\debug\\dism.log' END AS path, html AS content FROM pages)"


@R.add("m34_classify_logs", f"WITH {_LOGP}, c AS (SELECT *, CASE WHEN ends_with(path, '.evtx') THEN 'evtx' WHEN contains(path, 'Windows') THEN 'windows' WHEN starts_with(path, '/var/log') THEN 'linux' END AS log_class FROM lp) SELECT sha256(content) AS hash, min(path) AS path, count(*) AS copies FROM c WHERE log_class IS NOT NULL GROUP BY 1")
def m34(spark, d):
    p = v.table(spark, d, "pages")
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = (
        F.when(k == 0, F.concat(F.lit("C:\\Windows\\System32\\winevt\\Logs\\S"), n, F.lit(".evtx"))).when(k == 1, F.concat(F.lit("/var/log/app"), n))
        .when(k == 2, "C:\\Windows\\Temp\\setup.log").when(k == 3, "/home/u/syslog").otherwise("C:\\Windows\\debug\\dism.log")
    )
    return fx.classify_logs(p.select(path.alias("path"), F.col("html").alias("content"))).select("hash", "path", "copies")


@R.add("a12_export_findings", WITH_TU + f", {_TP}, {_ORDER}" + """
SELECT filename AS "Filename", 'LOW' AS "Severity", 25::BIGINT AS "Score", 'timestamp_order_anomaly' AS "Rule ID", round((c - m) / 86400000000::DOUBLE, 2) AS "Time Diff (Days)" FROM oc JOIN tp USING (filename) WHERE x IS NOT NULL""")
def a12(spark, d):
    rows = fx.order_anomalies(v.file_timeline(spark, d), v.journal(spark, d)).where("expected_value <> 'zero'")
    one = F.struct("rule_id", F.lit("order").alias("description"), "timestamp_value", "expected_value", "time_diff_seconds", F.lit("Timeline").alias("source_layer"))
    f = rows.select("filename", "severity", F.col("score").cast("bigint").alias("score"), F.array(one).alias("indicators"))
    return sinks.export_finding_frame(f).select("Filename", "Severity", "Score", "`Rule ID`", "`Time Diff (Days)`")
