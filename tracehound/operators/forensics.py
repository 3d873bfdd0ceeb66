"""File-timeline checks over tables of decoded records.

Every check yields indicator rows; scores are aggregations over them. Journals, logs and events are folded
per file before they meet the file table, and one-row bounds enter as scalar subqueries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.normalize import bind
from tracehound.operators.windows import lsn_gaps, lsn_order
from tracehound.rules import dims
from tracehound.rules.weights import CHECK_WEIGHTS, LAYER_POINTS, ROUND_DELTAS, SEVERITY_POINTS
from tracehound.schema import SECOND, micros, union_all

DAY = 86400


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return (micros(a) - micros(b)) / SECOND


def indicator(check: str, number: int, severity, confidence: float, votes: int = 1, seconds: Column | None = None, detail: Column | None = None) -> Column:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(
        F.lit(check).alias("check_id"), F.lit(number).alias("check_no"), sev.alias("severity"), F.lit(confidence).alias("confidence"),
        F.lit(votes).alias("votes"), (seconds if seconds is not None else F.lit(None)).cast("double").alias("seconds"),
        (detail if detail is not None else F.lit(None)).cast("string").alias("detail"),
    )


def spread(df: DataFrame, keys: list[str], *tries: Column) -> DataFrame:
    """One row per indicator that applies."""
    return df.select(*keys, F.inline(F.array_compact(F.array(*tries))))


def bit(reason: Column, mask: int) -> Column:
    return reason.bitwiseAND(F.lit(mask).cast("bigint")) != 0


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^\\/]*)$", 1))


def scalar_of(bound: DataFrame, col: str) -> Column:
    """The value of a one-row frame as a scalar subquery."""
    return bound.agg(F.max(col).alias("v")).scalar()


# --- record times ---------------------------------------------------------------------------------------


def si_fn_mismatch(f: DataFrame, now_year: int) -> DataFrame:
    """Standard and file-name times more than a second apart, high above a day; years in the future."""
    tries = []
    for name, a, b in (("created", "si_created", "fn_created"), ("modified", "si_modified", "fn_modified")):
        d = F.abs(seconds_between(a, b))
        tries.append(F.when(d > 1, indicator(f"{name}_mismatch", 1, F.when(d > DAY, "HIGH").otherwise("MEDIUM"), 0.8, seconds=d)))
    for name in ("created", "modified", "accessed"):
        tries.append(F.when(F.year(f"si_{name}") > now_year + 1, indicator(f"future_{name}", 1, "CRITICAL", 0.95)))
    return spread(f, ["partition", "record_no", "filename"], *tries)


def _round_match(d: Column) -> Column:
    return F.get(F.filter(F.array(*[F.lit(r) for r in ROUND_DELTAS]), lambda r: F.abs(d - r) < 60), F.lit(0))


def _deltas(f: DataFrame) -> list[tuple[str, Column]]:
    created = F.abs(seconds_between("si_created", "fn_created"))
    modified = F.when(F.col("si_created").isNotNull() & F.col("fn_created").isNotNull(), F.abs(seconds_between("si_modified", "fn_modified")))
    return [("created", created), ("modified", modified)]


def round_delta(f: DataFrame) -> DataFrame:
    """Differences close to a round span; else those above 30 days."""
    tries = []
    for name, d in _deltas(f):
        hit = _round_match(d)
        tries.append(F.when(
            d > 1,
            F.when(hit.isNotNull(), indicator(f"{name}_round_delta", 1, "HIGH", 0.9, seconds=d, detail=hit))
            .when(d > 30 * DAY, indicator(f"{name}_large_delta", 1, "HIGH", 0.7, seconds=d)),
        ))
    return spread(f, ["partition", "record_no", "filename"], *tries)


def batch_delta(f: DataFrame, least: int = 3) -> DataFrame:
    """The round difference most files share, when ``least`` or more do."""
    deltas = f.select(F.explode(F.array(*[d for _, d in _deltas(f)])).alias("d")).where("d > 1")
    hits = deltas.select(_round_match(F.col("d")).alias("delta")).where("delta IS NOT NULL").groupBy("delta").agg(F.count("*").alias("n"))
    return hits.orderBy(F.desc("n"), "delta").limit(1).where(F.col("n") >= least)


def sequence_checks(f: DataFrame, volume_created: Column, jump: int = 10) -> DataFrame:
    """Sequence jumps of one record number, creation before 2000 or more than a year before the volume."""
    tops = f.groupBy("partition", "record_no").agg(F.max("sequence_no").alias("top"), F.count("*").alias("copies"))
    j = f.join(tops, ["partition", "record_no"])
    years = F.floor(seconds_between(volume_created, "si_created") / DAY) / 365
    return spread(
        j, ["partition", "record_no", "filename"],
        F.when((F.col("copies") > 1) & (F.col("top") > F.col("sequence_no") + jump), indicator("sequence_jump", 8, "HIGH", 0.75)),
        F.when(F.year("si_created") < 2000, indicator("old_timestamp_new_seq", 8, "MEDIUM", 0.6)),
        F.when((F.col("si_created") < volume_created) & (years > 1), indicator("seq_vs_volume", 8, "HIGH", 0.75)),
    )


# --- journal --------------------------------------------------------------------------------------------


def usn_per_file(u: DataFrame) -> DataFrame:
    """What the journal says about each file reference: first write, first creation, rows."""
    r = F.col("reason")
    return u.groupBy(F.col("file_ref").alias("record_no")).agg(
        F.count("*").alias("usn_rows"), F.min(F.when(bit(r, dims.USN_WRITE), F.col("ts"))).alias("first_write"),
        F.min(F.when(bit(r, dims.USN_CREATE), F.col("ts"))).alias("first_create"),
    )


def with_usn(f: DataFrame, u: DataFrame) -> DataFrame:
    return f.join(usn_per_file(u), "record_no", "left")


def usn_causality(f: DataFrame, u: DataFrame) -> DataFrame:
    """Modification before the first journalled write; files the journal does not know."""
    tries = [F.when(F.col("usn_rows").isNull(), indicator("usn_absent", 2, "MEDIUM", 0.5))]
    for name in ("si_modified", "fn_modified"):
        tries.append(F.when(F.col(name) < F.col("first_write"), indicator(f"{name}_before_write", 2, "CRITICAL", 0.95, 2, seconds_between("first_write", name))))
    return spread(with_usn(f, u), ["partition", "record_no", "filename"], *tries)


def usn_create(f: DataFrame, u: DataFrame) -> DataFrame:
    """Creation time against the journal's creation record, first reason that applies."""
    si, fn = F.abs(seconds_between("first_create", "si_created")), F.abs(seconds_between("first_create", "fn_created"))
    reason = (
        F.when(F.col("first_create").isNull(), "missing").when(si > DAY, "si_differs").when(fn > DAY, "fn_differs")
        .when(F.col("si_created") < F.col("first_create"), "before_create").otherwise("consistent")
    )
    return with_usn(f, u).select(
        "partition", "record_no", "filename", reason.alias("reason"), (reason != "consistent").alias("is_suspicious"),
        F.when(reason == "before_create", "CRITICAL").when(reason == "consistent", "LOW").otherwise("HIGH").alias("severity"),
    )


def usn_events(u: DataFrame, kind: str) -> DataFrame:
    mask = {"create": dims.USN_CREATE, "delete": dims.USN_DELETE, "rename": dims.USN_RENAME}[kind]
    return u.where(bit(F.col("reason"), mask))


# --- transaction log ------------------------------------------------------------------------------------


def lsn_per_file(l: DataFrame) -> DataFrame:
    return l.where("file_ref IS NOT NULL").groupBy(F.col("file_ref").bitwiseAND(F.lit(dims.FILE_REF_MASK)).alias("record_no")).agg(
        F.count("*").alias("lsn_rows"), F.min("ts").alias("first_activity"), F.max("ts").alias("last_activity")
    )


def with_lsn(f: DataFrame, l: DataFrame) -> DataFrame:
    return f.join(lsn_per_file(l), "record_no", "left")


def lsn_checks(f: DataFrame, l: DataFrame) -> DataFrame:
    """Falling times in the log of a file, and times more than a day before its first activity."""
    keys = ["partition", "record_no", "filename"]
    falls = lsn_order(l).groupBy("record_no").agg(F.count("*").alias("falls"))
    j = with_lsn(f, l).join(falls, "record_no", "left")
    tries = [F.when(F.col("falls") > 0, indicator("lsn_order", 3, "HIGH", 0.85, detail=F.col("falls")))]
    for name in ("si_created", "si_modified"):
        gap = seconds_between("first_activity", name)
        tries.append(F.when(gap > DAY, indicator(f"{name}_before_log", 3, "HIGH", 0.85, 2, gap)))
    return spread(j, keys, *tries)


def lsn_view(l: DataFrame, kind: str) -> DataFrame:
    """Set-file-information, metadata, rename or timestamp operations."""
    cond = F.col("op_code").isin(dims.LSN_VIEWS[kind])
    if kind == "rename":
        cond = cond | F.contains("details", F.lit("Rename"))
    return l.where(cond)


def lsn_profile(l: DataFrame) -> DataFrame:
    """Number of records per view and in all, with the number of gaps."""
    gaps = lsn_gaps(l).agg(F.count("*").alias("n")).scalar()
    counts = [F.count_if(F.col("op_code").isin(codes)).alias(kind) for kind, codes in dims.LSN_VIEWS.items()]
    return l.agg(F.count("*").alias("total_records"), *counts).select("*", gaps.alias("gaps"))


# --- bounds ---------------------------------------------------------------------------------------------


def volume_bound(f: DataFrame, volume_created: Column) -> DataFrame:
    tries = [
        F.when(F.col(c) < volume_created, indicator(f"{c}_before_volume", 4, "CRITICAL", 0.99, 2, seconds_between(volume_created, c)))
        for c in ("si_created", "fn_created")
    ]
    return spread(f, ["partition", "record_no", "filename"], *tries)


SYSTEM_PATHS = r"\\windows\\|\\program files|\\system32\\|\\programdata\\"


def install_bound(f: DataFrame, installed: Column) -> DataFrame:
    """Creation before the system was installed; system paths are excused."""
    own = F.lower("filename").rlike(SYSTEM_PATHS)
    tries = [
        F.when(F.col(c) < installed, F.when(own, indicator(f"{c}_before_install", 5, "LOW", 0.3, 0)).otherwise(indicator(f"{c}_before_install", 5, "CRITICAL", 0.95, 2)))
        for c in ("si_created", "fn_created")
    ]
    return spread(f, ["partition", "record_no", "filename"], *tries)


def boot_bound(f: DataFrame, boots: DataFrame) -> DataFrame:
    """Modification earlier than a boot of the same day; the day's last boot stands for all of them."""
    per_day = boots.groupBy(F.to_date("boot").alias("day")).agg(F.max("boot").alias("boot"))
    times = f.select("partition", "record_no", "filename", F.inline(F.array(
        F.struct(F.lit("si_modified").alias("which"), F.col("si_modified").alias("at")), F.struct(F.lit("fn_modified").alias("which"), F.col("fn_modified").alias("at")),
    ))).withColumn("day", F.to_date("at"))
    j = times.join(per_day, "day").where(F.col("at") < F.col("boot"))
    return spread(j, ["partition", "record_no", "filename"], indicator("before_boot", 6, "HIGH", 0.8, 1, seconds_between("boot", "at"), F.col("which")))


def time_changes(ev: DataFrame) -> DataFrame:
    """Time-change events as one indicator; no row without such events."""
    n = ev.where(F.col("event_id").isin(4616, 1)).agg(F.count("*").alias("events"))
    return n.where("events > 0").select("events", F.lit("time_change_events").alias("check_id"), F.lit("HIGH").alias("severity"), F.lit(0.85).alias("confidence"), F.lit(2).alias("votes"))


def snapshot_gap(f: DataFrame, snaps: DataFrame, files: DataFrame) -> DataFrame:
    """Files created before some snapshot and present in none taken after their creation."""
    last_seen = files.join(snaps, "snapshot_id").groupBy(F.lower("path").alias("path")).agg(F.max("taken_at").alias("seen"))
    newest = scalar_of(snaps, "taken_at")
    j = f.join(last_seen, F.lower("filename") == F.col("path"), "left")
    gone = (F.col("si_created") < newest) & (F.col("seen").isNull() | (F.col("seen") <= F.col("si_created")))
    return spread(j, ["partition", "record_no", "filename"], F.when(gone, indicator("snapshot_gap", 11, "HIGH", 0.85, 2)))


# --- distributions --------------------------------------------------------------------------------------


def _four_times(f: DataFrame) -> DataFrame:
    return f.select(F.explode(F.array("si_created", "si_modified", "fn_created", "fn_modified")).alias("t")).where("t IS NOT NULL")


def second_cluster(f: DataFrame, least: int = 5, rows: int = 10) -> DataFrame:
    """The second most times share, when ``least`` or more do and there are ``rows`` times at all."""
    t = _four_times(f)
    total = t.agg(F.count("*").alias("n")).scalar()
    g = t.groupBy(F.date_trunc("second", "t").alias("second")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return g.orderBy(F.desc("n"), "second").limit(1).where(total >= rows)


def time_concentration(f: DataFrame, rows: int = 50) -> DataFrame:
    """Share of the busiest creation minute and year, where it is high."""
    t = f.where("si_created IS NOT NULL").select("si_created")
    total = t.agg(F.count("*").alias("n")).scalar()
    out = []
    for unit in ("minute", "year"):
        top = t.groupBy(F.date_trunc(unit, "si_created").alias("at")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "at").limit(1)
        ratio = F.col("n") / total
        sev = F.when(ratio > 0.8, "HIGH").otherwise("MEDIUM") if unit == "minute" else F.lit("MEDIUM")
        out.append(top.where((total >= rows) & (ratio > (0.5 if unit == "minute" else 0.9))).select(F.lit(unit).alias("unit"), "at", "n", ratio.alias("ratio"), sev.alias("severity")))
    return union_all(out)


def dir_cluster(t: DataFrame, files: int = 10, dirs: int = 5) -> DataFrame:
    """Creation minutes shared by more than ``files`` files in more than ``dirs`` directories."""
    minute = F.substring("created", 1, 16)
    folder = F.nullif(F.regexp_extract("filename", r"^(.*)/[^/]*$", 1), F.lit(""))
    g = t.where("created <> '' AND filename <> ''").groupBy(minute.alias("minute")).agg(F.count("*").alias("files"), F.countDistinct(folder).alias("dirs"))
    return g.where((F.col("files") > files) & (F.col("dirs") > dirs))


def subsecond(f: DataFrame, rows: int = 20) -> DataFrame:
    """Share of times without a sub-second part, and of the most repeated part."""
    us = _four_times(f).select((F.pmod(micros("t"), F.lit(SECOND))).alias("us"))
    total = us.agg(F.count("*").alias("n")).scalar()
    zero = us.agg(F.count_if(F.col("us") == 0).alias("n")).select(
        F.when(F.col("n") / total > 0.95, "all_zero_microseconds").when(F.col("n") / total > 0.8, "mostly_zero_microseconds").alias("check_id"),
        F.when(F.col("n") / total > 0.95, "MEDIUM").otherwise("LOW").alias("severity"), "n", (F.col("n") / total).alias("ratio"),
    )
    top = us.groupBy("us").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "us").limit(1).select(
        F.when((F.col("us") != 0) & (F.col("n") / total > 0.4), "repetitive_microseconds").alias("check_id"), F.lit("HIGH").alias("severity"), "n", (F.col("n") / total).alias("ratio"),
    )
    return zero.unionByName(top).where((F.col("check_id").isNotNull()) & (total >= rows))


def journal_integrity(u: DataFrame, l: DataFrame, s: DataFrame) -> DataFrame:
    """Signs that journals were wiped: short span, small log, no snapshots."""
    usn = u.agg(F.count("*").alias("n"), F.floor(seconds_between(F.max("ts"), F.min("ts")) / DAY).alias("days"))
    a = usn.where((F.col("days") < 7) & (F.col("n") > 100)).select(F.lit("usn_recent_start").alias("check_id"), F.lit("MEDIUM").alias("severity"), F.lit(1).alias("votes"), "n")
    log = l.agg(F.count("*").alias("n"), F.max("lsn").alias("top"))
    b = log.where((F.col("top") < 1_000_000) & (F.col("n") < 100)).select(F.lit("logfile_small").alias("check_id"), F.lit("HIGH").alias("severity"), F.lit(2).alias("votes"), "n")
    c = s.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no_shadow_copies").alias("check_id"), F.lit("LOW").alias("severity"), F.lit(1).alias("votes"), "n")
    return union_all([a, b, c])


# --- text timeline --------------------------------------------------------------------------------------


def parsed_times(t: DataFrame) -> DataFrame:
    """Timeline with its text times as timestamps beside the texts; a time that does not parse is null."""
    return t.withColumns({f"{c}_ts": F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss")) for c in ("created", "modified")})


def _row(rule: str, severity: str, score: int, value: Column | str, seconds: Column | None = None, expected=None) -> Column:
    return F.struct(
        F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(score).alias("score"), (F.col(value) if isinstance(value, str) else value).alias("timestamp_value"),
        (F.lit(expected) if not isinstance(expected, Column) else expected).cast("string").alias("expected_value"), (seconds if seconds is not None else F.lit(None)).cast("double").alias("time_diff_seconds"),
    )


def _zero(col: str) -> Column:
    return F.col(col).rlike("1601-01-01|0000-00-00")


def timeline_rules(t: DataFrame, now_year: int) -> DataFrame:
    """Future years, zero times and years before 1990."""
    p = parsed_times(t)
    y = F.year("created_ts")
    excused = F.lower("filename").rlike(r"\$mbr|\$fat|\$boot|volume label|\$phan|orphan")
    return spread(
        p, ["filename"],
        F.when(y > now_year + 1, _row("future_timestamp", "CRITICAL", 100, "created", expected=str(now_year))),
        F.when(_zero("created") & ~F.contains("type", F.lit("*")) & ~excused, _row("zero_timestamp", "HIGH", 75, "created", expected="Valid date after 1970")),
        F.when(y < 1990, _row("ancient_timestamp", "MEDIUM", 50, "created", expected="> 1990-01-01")),
    )


def usn_by_name(u: DataFrame) -> DataFrame:
    r = F.col("reason")
    return u.groupBy(F.lower("file_name").alias("name")).agg(
        F.bool_or(bit(r, dims.USN_CREATE)).alias("has_create"), F.bool_or(bit(r, 0x33)).alias("has_write"), F.min("ts").alias("earliest"),
    )


def order_anomalies(t: DataFrame, u: DataFrame) -> DataFrame:
    """Modification before creation judged by the journal, and zero times."""
    p = parsed_times(t).where(~F.lower("filename").rlike(r"\$|shadowindex|snapshot")).withColumn("name", base_name(F.col("filename")))
    j = p.join(usn_by_name(u), "name", "left")
    days = F.floor(seconds_between("created_ts", "modified_ts") / DAY)
    reversed_, known = F.col("modified_ts") < F.col("created_ts"), F.col("has_create").isNotNull()
    between = (F.col("earliest") > F.col("created_ts")) & (F.col("earliest") < F.col("modified_ts"))
    case = (
        F.when(~reversed_ | ~known | (F.col("has_create") & ~F.col("has_write")), F.lit(None).cast("string"))
        .when(F.col("has_write") & between, "writes_between").when(F.col("has_write") & (days > 365), "old_with_activity").when(days > 365, "verify")
    )
    excused = F.lower("filename").rlike(r"volume label|orphan|fat|boot")
    zero = (_zero("created") | _zero("modified") | _zero("accessed")) & ~F.contains("type", F.lit("*")) & ~excused
    found = j.withColumn("case", case)
    return spread(
        found, ["filename"],
        F.when(F.col("case").isNotNull(), _row("timestamp_order_anomaly", "LOW", 25, "created", seconds_between("created_ts", "modified_ts"), F.col("case"))),
        F.when(zero, _row("timestamp_order_anomaly", "HIGH", 75, "created", expected="zero")),
    )


def possibly_copied(t: DataFrame, u: DataFrame) -> DataFrame:
    """Files modified before they were created, when there is no journal to judge them by."""
    journal = u.agg(F.count("*").alias("n")).scalar()
    p = parsed_times(t).where(~F.lower("filename").rlike(r"\$|shadowindex|snapshot"))
    return p.where((F.col("modified_ts") < F.col("created_ts")) & (journal == 0)).select("filename", "created", "modified").distinct()


def usn_missing(t: DataFrame, u: DataFrame, before_year: int = 2015) -> DataFrame:
    """Old files that a journal with rows does not mention."""
    names = u.select(F.lower("file_name").alias("name")).distinct()
    journal = u.agg(F.count("*").alias("n")).scalar()
    old = parsed_times(t).where(F.year("created_ts") < before_year).withColumn("name", base_name(F.col("filename")))
    return spread(old.join(names, "name", "left_anti").where(journal > 0), ["filename"], _row("usn_missing", "MEDIUM", 25, "created"))


def event_bounds_check(t: DataFrame, ev: DataFrame) -> DataFrame:
    """Creation more than a day after the last event, or more than five years before the first."""
    last, first = scalar_of(ev, "ts"), ev.agg(F.min("ts").alias("v")).scalar()
    p = parsed_times(t)
    after = F.floor(seconds_between("created_ts", last) / DAY)
    before = F.floor(seconds_between(first, "created_ts") / DAY)
    return spread(
        p, ["filename"], F.when(after > 1, _row("si_after_event_logs", "HIGH", 75, "created", after * DAY)),
        F.when(before > 365 * 5, _row("si_before_event_logs", "MEDIUM", 25, "created", before * DAY)),
    )


def exact_delta(t: DataFrame, rows: int = 10) -> DataFrame:
    """Creation and modification exactly an hour, a day or a year apart."""
    p = parsed_times(t).where("created_ts IS NOT NULL AND modified_ts IS NOT NULL").withColumn("d", F.abs(seconds_between("created_ts", "modified_ts")))
    total = p.agg(F.count("*").alias("n")).scalar()
    return spread(p.where(F.col("d").isin(3600.0, 86400.0, 31536000.0) & (total >= rows)), ["filename"], _row("si_fn_round_delta", "MEDIUM", 50, "created", F.col("d")))


def timeline_volume_bound(t: DataFrame, days: int = 30) -> DataFrame:
    """Creation more than ``days`` before the oldest system file, or the oldest file when there is none."""
    p = parsed_times(t)
    system = F.lower("filename").rlike(r"\$boot|\$mft|\$volume")
    volume = p.agg(F.coalesce(F.min(F.when(system, F.col("created_ts"))), F.min("created_ts")).alias("v")).scalar()
    gap = F.floor(seconds_between(volume, "created_ts") / DAY)
    return spread(p.where((gap > days) & ~F.lower("filename").rlike(r"\$|shadowindex|system volume")), ["filename"], _row("volume_boundary_violation", "HIGH", 50, "created", gap * DAY))


def log_cleared(files: DataFrame, logs: DataFrame) -> DataFrame:
    """Every listed file gets the mark of a cleared log, when the log listings say so."""
    cleared = logs.agg(F.count_if(F.lower("line").rlike("cleared|wevtutil")).alias("n")).scalar()
    return spread(files.where(cleared > 0), ["filename"], _row("log_clearing", "CRITICAL", 100, F.lit(None).cast("string")))


def prefetch_gap(t: DataFrame, p: DataFrame, now: Column) -> DataFrame:
    """Executables younger than 30 days without a prefetch file of their stem."""
    stems = p.select(F.upper(F.regexp_extract("name", r"^([^.\-]+)", 1)).alias("stem")).distinct()
    exe = parsed_times(t).where(F.lower("filename").endswith(".exe"))
    age = F.floor(seconds_between(now, "created_ts") / DAY)
    recent = exe.where((age > 0) & (age < 30)).withColumn("stem", F.upper(F.regexp_extract(base_name(F.col("filename")), r"^([^.\-]+)", 1)))
    return spread(recent.join(stems, "stem", "left_anti"), ["filename"], _row("prefetch_missing", "LOW", 10, "created"))


def presence(sources: dict[str, DataFrame], least: int = 3) -> DataFrame:
    """Names that occur in ``least`` artifact sources or more; each source has a ``name`` column.

    One aggregation by name with a flag per source: a task holds each of its names once, without a set.
    """
    rows = union_all([df.select(F.lower("name").alias("name"), *[F.lit(s == own).alias(f"_s{i}") for i, s in enumerate(sources)]) for own, df in sources.items()])
    g = rows.groupBy("name").agg(*[F.bool_or(f"_s{i}").alias(f"_s{i}") for i in range(len(sources))])
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_s{i}"), F.lit(s)) for i, s in enumerate(sources)])))
    return g.select("name", F.size(found).cast("bigint").alias("sources"), found.alias("found_in")).where(F.col("sources") >= least)


def timeline_gap(t: DataFrame, days: int = 365) -> DataFrame:
    """Plain files whose creation and modification lie more than ``days`` apart, one row per name."""
    p = parsed_times(t).where(F.ltrim("type").startswith("r/") & ~F.startswith("filename", F.lit("$")))
    gap = F.abs(F.floor(seconds_between("created_ts", "modified_ts") / DAY))
    return p.withColumn("gap_days", gap).where(F.col("gap_days") > days).groupBy("filename").agg(F.max("gap_days").alias("gap_days")).select(
        "filename", "gap_days", F.lit("MEDIUM").alias("severity"), F.lit(25.0).alias("score")
    )


# --- events ---------------------------------------------------------------------------------------------


def event_paths(ev: DataFrame) -> DataFrame:
    """Values of the event data that look like paths, with their base name."""
    v = ev.select("record_id", "event_id", "ts", F.explode(F.map_values("event_data")).alias("v"))
    like = F.col("v").rlike(r"[\\/]") & (F.length("v") > 10) & ~F.startswith("v", F.lit("S-1-"))
    return v.where(like).select("record_id", "event_id", "ts", F.lower("v").alias("path")).withColumn("name", base_name(F.col("path")))


def file_paths(f: DataFrame, paths: DataFrame) -> DataFrame:
    """For each file name: the event paths that end with it."""
    names = f.select(base_name(F.col("filename")).alias("name")).distinct()
    return paths.select("name", "path").distinct().join(names, "name", "left_semi")


def _event_kind(event_id: Column) -> Column:
    out = None
    for kind, ids in dims.FILE_EVENT_KINDS.items():
        out = F.when(event_id.isin(ids), kind) if out is None else out.when(event_id.isin(ids), kind)
    return out


def file_events(f: DataFrame, ev: DataFrame, late: int = 300) -> DataFrame:
    """Events near a file by kind; high where the file claims to be created more than ``late`` seconds after one.

    Events are folded per path and kind first, so a busy path is one row when it meets its files.
    """
    paths = event_paths(ev).withColumn("kind", _event_kind(F.col("event_id"))).where("kind IS NOT NULL")
    folded = paths.groupBy("path", "kind").agg(F.count("*").alias("n"), F.min("ts").alias("first_event"))
    per_name = folded.join(file_paths(f, event_paths(ev)), "path").groupBy("name", "kind").agg(F.sum("n").alias("events"), F.min("first_event").alias("first_event"))
    j = f.withColumn("name", base_name(F.col("filename"))).join(per_name, "name")
    gap = seconds_between("si_created", "first_event")
    return j.select("partition", "record_no", "filename", "kind", "events", "first_event", gap.alias("seconds"), F.when(gap > late, "HIGH").otherwise("INFO").alias("severity"))


# --- scores ---------------------------------------------------------------------------------------------


def layered_score(f: DataFrame, u: DataFrame, l: DataFrame, ev: DataFrame, now_year: int) -> DataFrame:
    """Five layers of evidence per file: points, band, confidence, what was found, what to do."""
    pts = LAYER_POINTS
    no_journal = u.agg(F.count("*").alias("n")).scalar() == 0
    sec = ev.agg(F.max(F.when(F.lower("channel") == "security", F.col("ts"))).alias("v")).scalar()
    sysm = ev.agg(F.max(F.when(F.lower("channel") == "system", F.col("ts"))).alias("v")).scalar()
    marked = file_events(f, ev).where("severity = 'HIGH'").select("record_no", "partition").distinct().withColumn("ev_hit", F.lit(True))
    j = f.join(usn_per_file(u), "record_no", "left").join(lsn_per_file(l), "record_no", "left").join(marked, ["record_no", "partition"], "left")

    c, m = F.abs(seconds_between("si_created", "fn_created")), F.abs(seconds_between("si_modified", "fn_modified"))
    l1 = F.when((c > DAY) | (m > DAY), pts["si_fn"]).when((c > 1) | (m > 1), pts["si_fn"] * 0.5).otherwise(0.0)
    d2 = F.abs(seconds_between("si_created", "first_create"))
    l2 = (
        F.when(no_journal, pts["usn"]).when(F.col("first_create").isNull(), 0.0).when(F.col("si_created") < F.col("first_create"), pts["usn"])
        .when(d2 > DAY, pts["usn"]).when(d2 > 60, pts["usn"] * 0.5).otherwise(0.0)
    )
    d3 = seconds_between("first_activity", "si_created")
    l3 = F.when(d3 > 0, F.when(d3 > DAY, pts["logfile"]).otherwise(0.0)).when(-d3 > 7 * DAY, pts["logfile"] * 0.5).otherwise(0.0)
    y = F.year("si_created")
    l4 = F.when(y > now_year + 1, pts["external"]).when(y == 1601, pts["external"] * 0.5).otherwise(0.0)
    l5 = (
        F.when(F.coalesce("ev_hit", F.lit(False)), pts["events"]).when(seconds_between("si_created", sec) > DAY, pts["events"])
        .when(seconds_between("si_created", sysm) > DAY, pts["events"] * 0.5).otherwise(0.0)
    )
    scored = j.select("partition", "record_no", "filename", l1.alias("layer1"), l2.alias("layer2"), l3.alias("layer3"), l4.alias("layer4"), l5.alias("layer5"))
    layers = ["layer1", "layer2", "layer3", "layer4", "layer5"]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in layers[1:]), F.coalesce(layers[0], F.lit(0.0)))
    names = ["record times", "change journal", "transaction log", "outside bounds", "event log"]
    s = scored.withColumn("score", total)
    return s.withColumn("severity", F.when(F.col("score") >= 75, "CRITICAL").when(F.col("score") >= 50, "HIGH").when(F.col("score") >= 25, "MEDIUM").otherwise("LOW")).withColumns({
        "is_suspicious": F.col("score") >= 25,
        "confidence": F.when(F.col("score") >= 75, 0.95).when(F.col("score") >= 50, 0.8).when(F.col("score") >= 25, 0.6).otherwise(0.3),
        "explanation": F.array_join(F.array_compact(F.array(*[F.when(F.col(x) > 0, n) for x, n in zip(layers, names)])), "; "),
        "recommendation": F.when(F.col("severity") == "CRITICAL", "Several layers contradict the file's times: treat them as forged and look for the tool that set them.")
        .when(F.col("severity") == "HIGH", "Two layers or more disagree: compare the file with prefetch and event records of its time.")
        .when(F.col("severity") == "MEDIUM", "One layer disagrees: an installer or a copy may explain it.")
        .otherwise("The layers agree."),
    })


def contradictions(f: DataFrame, u: DataFrame, l: DataFrame, volume_created: Column, installed: Column) -> DataFrame:
    """Votes against each file, one row per independent layer: record order 2/1, the others 2 each.

    Files meet the folded journal and log once; the layers are columns of that one pass.
    """
    keys = ["partition", "record_no", "filename"]
    falls = lsn_order(l).groupBy("record_no").agg(F.count("*").alias("falls"))
    j = f.join(usn_per_file(u), "record_no", "left").join(lsn_per_file(l), "record_no", "left").join(falls, "record_no", "left")
    apart = [F.abs(seconds_between(f"si_{n}", f"fn_{n}")) for n in ("created", "modified")]
    before_log = [seconds_between("first_activity", f"si_{n}") > DAY for n in ("created", "modified")]
    any_of = lambda conds: reduce(lambda x, y: x | y, [F.coalesce(c, F.lit(False)) for c in conds])
    votes = {
        "record_order": F.when(any_of([d > DAY for d in apart]), 2).when(any_of([d > 1 for d in apart]), 1),
        "usn": F.when(any_of([F.col(f"{n}_modified") < F.col("first_write") for n in ("si", "fn")]), 2),
        "logfile": F.when(any_of([F.col("falls") > 0, *before_log]), 2),
        "volume": F.when(F.col("si_created") < volume_created, 2), "install": F.when(F.col("si_created") < installed, 2),
    }
    per_file = j.groupBy(*keys).agg(*[F.max(v).alias(n) for n, v in votes.items()])
    rows = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("votes"), F.lit(n).alias("layer"))) for n in votes]))
    return per_file.select(*keys, F.inline(rows))


def vote(i: DataFrame) -> DataFrame:
    """Sum of the votes per file with its band."""
    v = F.col("votes")
    return i.groupBy("partition", "record_no", "filename").agg(F.sum("votes").alias("votes")).select(
        "partition", "record_no", "filename", "votes", F.when(v >= 6, "CRITICAL").when(v >= 4, "HIGH").when(v >= 2, "MEDIUM").otherwise("INFO").alias("severity"),
        (v >= 4).alias("is_suspicious"), F.when(v >= 6, 100).when(v >= 4, 75).when(v >= 2, 50).otherwise(10).alias("score"),
    )


def _points(severity: Column) -> Column:
    out = None
    for name, p in SEVERITY_POINTS.items():
        out = F.when(severity == name, p) if out is None else out.when(severity == name, p)
    return out.otherwise(0)


def weighted_score(i: DataFrame) -> DataFrame:
    """Severity times confidence times check weight over what was possible, per file."""
    weight = None
    for no, w in CHECK_WEIGHTS.items():
        weight = F.when(F.col("check_no") == no, w) if weight is None else weight.when(F.col("check_no") == no, w)
    w = weight.otherwise(1.0)
    g = i.groupBy("partition", "record_no", "filename").agg(
        F.sum(_points(F.col("severity")) * F.col("confidence") * w).alias("got"), F.sum(w * 100).alias("possible"),
        F.count_if(F.col("severity") == "CRITICAL").alias("crit"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.count("*").alias("indicators"),
    )
    score = F.least(F.lit(100.0), F.col("got") / F.col("possible") * 100)
    sev = F.when((F.col("crit") > 0) | (score > 75), "CRITICAL").when((F.col("high") > 0) | (score > 50), "HIGH").when(score > 25, "MEDIUM").otherwise("INFO")
    return g.select("partition", "record_no", "filename", "indicators", score.alias("score"), sev.alias("severity"), sev.isin("CRITICAL", "HIGH").alias("is_suspicious"))


def additive_score(i: DataFrame) -> DataFrame:
    """Sum of the scores and worst severity per file."""
    g = i.groupBy(F.lower("filename").alias("filename")).agg(F.sum("score").alias("score"), F.max(_points(F.col("severity"))).alias("rank"), F.count("*").alias("indicators"))
    back = None
    for name, p in SEVERITY_POINTS.items():
        back = F.when(F.col("rank") == p, name) if back is None else back.when(F.col("rank") == p, name)
    return g.select("filename", "score", back.alias("severity"), "indicators").where("score > 0")


# --- listings -------------------------------------------------------------------------------------------


def evidence_rows(lines: DataFrame, now_year: int) -> DataFrame:
    """Hits of the evidence rules, one row per line and rule; ``lines`` has (partition, listing, line)."""
    tries = [
        F.when((F.col("listing") == listing) & F.col("line").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(typ).alias("type"), F.lit(sev).alias("severity")))
        for kind, listing, typ, sev, pattern in dims.EVIDENCE
    ]
    years = F.regexp_extract_all("line", F.lit(r"(\d{4})-(\d{2})-(\d{2})"), F.lit(1))
    future = F.exists(years, lambda y: y.cast("int") > now_year + 1)
    tries.append(F.when((F.col("listing") == "timeline") & future, F.struct(F.lit("timestomping").alias("kind"), F.lit("future_date").alias("type"), F.lit("high").alias("severity"))))
    # the first four dates and times of a line of six words or more: equal pairs are equal record and name times
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    stamps = F.filter(words, lambda w: w.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}:\d{2}:\d{2})"))
    same = bind(stamps, lambda t: (F.size(t) >= 4) & (F.get(t, F.lit(0)) == F.get(t, F.lit(2))) & (F.get(t, F.lit(1)) == F.get(t, F.lit(3))))
    tries.append(F.when((F.col("listing") == "timeline") & (F.size(words) >= 6) & same, F.struct(F.lit("timestomping").alias("kind"), F.lit("identical_times").alias("type"), F.lit("medium").alias("severity"))))
    return lines.select("partition", "line", F.inline(F.array_compact(F.array(*tries))))


def evidence_absence(lines: DataFrame) -> DataFrame:
    """What a listing of a partition lacks: the volume folder beside $Extend, event log files, any journal line.

    A listing counts as there when it has a line, be it blank. One row per partition and finding.
    """
    line, of = F.coalesce("line", F.lit("")), lambda name: F.col("listing") == name
    seen = lambda name, cond: F.coalesce(F.bool_or(of(name) & cond), F.lit(False))
    g = lines.groupBy("partition").agg(
        seen("shadow_copies", F.contains(line, F.lit("$Extend"))).alias("extend"), seen("shadow_copies", F.contains(line, F.lit("System Volume Information"))).alias("volume"),
        seen("logs", F.lit(True)).alias("logs"), seen("logs", F.contains(F.lower(line), F.lit(".evtx"))).alias("evtx"),
        seen("usn_journal", F.lit(True)).alias("journal"), seen("usn_journal", F.trim(line) != "").alias("filled"),
    )
    finding = lambda cond, *names: F.when(cond, F.struct(*[F.lit(n).alias(c) for n, c in zip(names, ("kind", "type", "severity"))]))
    return g.select("partition", F.inline(F.array_compact(F.array(
        finding(F.col("extend") & ~F.col("volume"), "shadow_copy", "volume_information_missing", "high"),
        finding(F.col("logs") & ~F.col("evtx"), "log_clearing", "no_event_logs", "high"),
        finding(F.col("journal") & ~F.col("filled"), "journal", "empty", "high"),
    ))))


def evidence_scan(lines: DataFrame, now_year: int) -> DataFrame:
    """Evidence per disk partition and kind: hits of lines, and one hit for each thing that is absent."""
    found = evidence_rows(lines, now_year).select("partition", "kind", "type", "severity").unionByName(evidence_absence(lines))
    return found.groupBy("partition", "kind", "type", "severity").agg(F.count("*").alias("hits"))


def log_class(path: Column) -> Column:
    """Kind of log file a path is, null for other files."""
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    windows = F.lit(False)
    for p in dims.WINDOWS_LOG_PATHS:
        windows = windows | F.contains(low, F.lit(p))
    named = F.lit(False)
    for n in dims.LOG_FILE_NAMES:
        named = named | F.contains(low, F.lit(n))
    exact = base_name(path).isin(dims.LOG_FILE_NAMES)
    return (
        F.when(low.endswith(".evtx"), F.when(windows, "evtx"))
        .when(windows, F.when(low.endswith(".log") | named, "windows")).when(F.contains(low, F.lit("var/log/")), "linux")
        .when(exact & F.contains(low, F.lit("windows")), "windows")
    )


def classify_logs(files: DataFrame) -> DataFrame:
    """Log files by class, one per content; ``files`` has (path, content)."""
    typed = files.withColumn("log_class", log_class(F.col("path"))).where("log_class IS NOT NULL")
    return typed.groupBy(F.sha2("content", 256).alias("hash")).agg(F.min(F.struct("path", "log_class")).alias("p"), F.count("*").alias("copies")).select("hash", "p.path", "p.log_class", "copies")
