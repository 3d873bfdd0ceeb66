"""Aggregates and summaries. Every one is a partial-plus-final aggregation; no group is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.rules.dims import REPORT_SEVERITIES
from tracehound.schema import is_attack


def count_by(e: DataFrame, *cols: str) -> DataFrame:
    """Counts per value of each column, one pass: (dimension, value, n)."""
    cols = cols or ("log_type", "severity", "outcome")
    flat = e.select(*[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in cols])
    counts = flat.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(
        F.count("*").alias("n"), F.grouping_id().alias("gid")
    )
    # grouping_id has a 0 bit for the one column that is grouped
    full = (1 << len(cols)) - 1
    dim, value = None, None
    for i, c in enumerate(cols):
        mask = full & ~(1 << (len(cols) - 1 - i))
        cond = F.col("gid") == mask
        dim = F.when(cond, F.lit(c)) if dim is None else dim.when(cond, F.lit(c))
        value = F.when(cond, F.col(c)) if value is None else value.when(cond, F.col(c))
    return counts.select(dim.alias("dimension"), value.alias("value"), "n")


def _top(e: DataFrame, col: str, name: str, n: int) -> DataFrame:
    return (
        e.where(F.col(col).isNotNull() & (F.col(col) != "")).groupBy(F.col(col).alias(name))
        .agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)
    )


def top_sources(e: DataFrame, n: int = 10) -> DataFrame:
    return _top(e, "source.ip", "ip", n)


def top_users(e: DataFrame, n: int = 10) -> DataFrame:
    return _top(e, "user.name", "user", n)


def minute_timeline(e: DataFrame) -> DataFrame:
    return e.where("ts IS NOT NULL").groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))


def minute_status(e: DataFrame, n: int) -> DataFrame:
    """Normal, anomalous and critical entries of the last ``n`` minutes that have entries."""
    crit, odd = F.col("severity") == "critical", F.coalesce("is_anomaly", F.lit(False))
    return (
        e.where("ts IS NOT NULL").groupBy(F.date_trunc("minute", "ts").alias("minute"))
        .agg(F.count_if(~crit & ~odd).alias("normal"), F.count_if(~crit & odd).alias("anomaly"), F.count_if(crit).alias("critical"))
        .orderBy(F.desc("minute")).limit(n)
    )


def hour_status(e: DataFrame, n: int) -> DataFrame:
    """Normal and anomalous entries per hour, last ``n`` hours that have entries; critical, error and tagged count as anomalous."""
    odd = F.col("severity").isin("critical", "error") | F.col("attack_type").isNotNull()
    return (
        e.where("ts IS NOT NULL").groupBy(F.date_trunc("hour", "ts").alias("hour"))
        .agg(F.count_if(~odd).alias("normal"), F.count_if(odd).alias("anomaly")).orderBy(F.desc("hour")).limit(n)
    )


def unique_counts(e: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return e.agg(count(F.col("source.ip")).alias("sources"), count(F.col("user.name")).alias("users"))


def severity_share(e: DataFrame, severities: list[str] | None = None) -> DataFrame:
    """Percent of entries per severity; severities without entries stay with 0."""
    spark = e.sparkSession
    dim = spark.createDataFrame([(s,) for s in severities or REPORT_SEVERITIES], "severity STRING")
    counts = e.groupBy("severity").agg(F.count("*").alias("n"))
    total = e.agg(F.count("*").alias("t")).scalar()
    return dim.join(counts, "severity", "left").select(
        "severity", F.coalesce("n", F.lit(0)).alias("n"),
        F.round(100.0 * F.coalesce("n", F.lit(0)) / F.when(total > 0, total), 2).alias("percent"),
    )


def attack_breakdown(e: DataFrame) -> DataFrame:
    return (
        e.where(is_attack()).groupBy("attack_type")
        .agg(F.count("*").alias("n"), F.avg("attack_confidence").alias("avg_confidence")).orderBy(F.desc("n"), "attack_type")
    )


def ip_profile(e: DataFrame) -> DataFrame:
    """Per IP (LOCAL left out): events, failures, distinct users, ports and actions, last event.

    Rows are first folded to distinct (IP, user, port, action), so the distinct counts run on few rows and
    a hot IP is spread over its combinations.
    """
    src, usr, prt = F.col("source.ip"), F.col("user.name"), F.col("source.port")
    folded = (
        e.where(src.isNotNull() & (src != "LOCAL"))
        .groupBy(src.alias("ip"), usr.alias("user"), prt.alias("port"), F.coalesce("action", F.lit("unknown")).alias("action"))
        .agg(F.count("*").alias("c"), F.count_if(F.col("outcome") == "failure").alias("f"), F.max(F.struct("ts", "id")).alias("last"))
    )
    return folded.groupBy("ip").agg(
        F.sum("c").alias("events"), F.sum("f").alias("failures"), F.countDistinct("user").alias("users"),
        F.countDistinct("port").alias("ports"), F.countDistinct("action").alias("actions"), F.max("last").alias("last"),
    ).select("ip", "events", "failures", "users", "ports", "actions", F.col("last.ts").alias("last_ts"), F.col("last.id").alias("last_id"))


def user_profile(e: DataFrame) -> DataFrame:
    """Per user (lower-cased, unknown left out): failures, successes, distinct IPs, shared failing and succeeding IPs."""
    usr = F.lower(F.col("user.name"))
    folded = (
        e.where(usr.isNotNull() & (usr != "unknown") & (usr != ""))
        .groupBy(usr.alias("user"), F.col("source.ip").alias("ip"))
        .agg(
            F.count("*").alias("c"), F.count_if(F.col("outcome") == "failure").alias("f"),
            F.count_if(F.col("outcome") == "success").alias("s"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        )
    )
    return folded.groupBy("user").agg(
        F.sum("c").alias("events"), F.sum("f").alias("failures"), F.sum("s").alias("successes"),
        F.count("ip").alias("ips"), F.count_if((F.col("f") > 0) & (F.col("s") > 0)).alias("shared_ips"),
        F.min("first").alias("start_ts"), F.max("last").alias("end_ts"),
    )


def attack_summary(e: DataFrame) -> DataFrame:
    """Attacks, anomalies, attack types, attacking IPs and the capped risk score."""
    attack, odd = is_attack(), F.coalesce("is_anomaly", F.lit(False))
    return e.agg(
        F.count_if(attack).alias("total_attacks"), F.count_if(odd).alias("total_anomalies"),
        F.array_sort(F.collect_set(F.when(attack, F.col("attack_type")))).alias("attack_types"),
        F.countDistinct(F.when(attack, F.col("source.ip"))).alias("attack_sources"),
    ).withColumn("risk_score", F.least(F.col("total_attacks") * 10 + F.col("total_anomalies") * 5, F.lit(100)))


def summary_basic(e: DataFrame, chains: DataFrame) -> DataFrame:
    """Risk score, critical alerts and number of chains: 20 per chain, 10 per critical, 5 per error entry."""
    n = chains.agg(F.count("*").alias("n")).scalar()
    return e.agg(
        F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        F.count_if(F.col("severity") == "error").alias("errors"), F.count("*").alias("total_events"),
    ).select(
        "total_events", "critical_alerts", n.alias("chains"),
        F.least(F.lit(100), n * 20 + F.col("critical_alerts") * 10 + F.col("errors") * 5).alias("risk_score"),
    )


def threat_scores(e: DataFrame, chain_ips: DataFrame, n: int = 10) -> DataFrame:
    """Most active IPs with the summed confidence of their chains, at most 1; ``chain_ips`` has (ip, confidence)."""
    threat = chain_ips.groupBy("ip").agg(F.sum("confidence").alias("threat"))
    return top_sources(e, n).join(threat, "ip", "left").select(
        "ip", "n", F.least(F.coalesce("threat", F.lit(0.0)), F.lit(1.0)).alias("threat_score")
    )


def chain_ip_threats(links: DataFrame, n: int = 10) -> DataFrame:
    """Per IP: chains times distinct attack types, best first; ``links`` has (chain_id, attack_type, ip)."""
    return (
        links.groupBy("ip").agg(F.count("*").alias("chains"), F.countDistinct("attack_type").alias("types"))
        .withColumn("threat_score", F.col("chains") * F.col("types")).orderBy(F.desc("threat_score"), "ip").limit(n)
    )


def summary_enhanced(e: DataFrame, chains: DataFrame, links: DataFrame) -> DataFrame:
    """15 per chain, 20 per critical, 10 per high entry and 5 per IP of a chain, at most 100."""
    n = chains.agg(F.count("*").alias("n")).scalar()
    ips = links.agg(F.countDistinct("ip").alias("n")).scalar()
    return e.agg(
        F.count("*").alias("total_alerts"), F.count_if(F.lower("severity") == "critical").alias("critical_alerts"),
        F.count_if(F.lower("severity") == "high").alias("high_alerts"),
    ).select(
        "total_alerts", "critical_alerts", n.alias("chains"),
        F.least(n * 15 + F.col("critical_alerts") * 20 + F.col("high_alerts") * 10 + ips * 5, F.lit(100)).alias("risk_score"),
    )


def summary_api(chains: DataFrame, timeline: DataFrame) -> DataFrame:
    events = timeline.agg(F.count("*").alias("n")).scalar()
    return chains.agg(
        F.count("*").alias("total_chains"), F.count_if(F.col("confidence") > 0.85).alias("critical_alerts")
    ).withColumn("risk_score", F.least(F.col("total_chains") * 15 + events * 2, F.lit(100)))


def risk_bands(counts: DataFrame, kind: str) -> DataFrame:
    """Report bands of an IP or user count."""
    n = F.col("n")
    band = (
        F.when(n > 100, "HIGH").when(n > 50, "MEDIUM").otherwise("LOW") if kind == "ip"
        else F.when(n > 50, "CRITICAL").when(n > 20, "HIGH").otherwise("MEDIUM")
    )
    return counts.withColumn("risk", band)


def feedback_stats(fb: DataFrame, versions: DataFrame, now) -> DataFrame:
    """Totals, safe and unsafe labels, last day's count, versions and the active one."""
    n_versions = versions.agg(F.count("*").alias("n")).scalar()
    active = versions.agg(F.max(F.when(F.col("is_active"), F.col("version_id"))).alias("v")).scalar()
    return fb.agg(
        F.count("*").alias("total_feedback"), F.count_if(F.col("user_label") == "safe").alias("safe_count"),
        F.count_if(F.col("user_label") == "unsafe").alias("unsafe_count"),
        F.count_if(F.col("timestamp") > now - F.expr("INTERVAL 24 HOURS")).alias("recent_feedback_count"),
    ).select("*", n_versions.alias("model_versions"), active.alias("current_version"))


def feedback_by_prediction(fb: DataFrame) -> DataFrame:
    return fb.groupBy("original_prediction").agg(F.count("*").alias("n"))


def prediction_summary(p: DataFrame) -> DataFrame:
    return p.agg(
        F.count("*").alias("total_logs"), F.count_if(F.col("is_attack")).alias("attacks_detected"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
    ).withColumn("risk_score", F.least(F.col("attacks_detected") * 10, F.lit(100)))


def indicator_summary(i: DataFrame) -> DataFrame:
    """Indicators per kind, with the total and the risk level of the whole set."""
    per_kind = i.groupBy("kind").agg(F.count("*").alias("n"))
    total = i.agg(F.count("*").alias("t")).scalar()
    return per_kind.select(
        "kind", "n", total.alias("total"),
        F.when(total == 0, "LOW").when(total < 5, "MEDIUM").otherwise("HIGH").alias("risk_level"),
    )


def finding_summary(f: DataFrame) -> DataFrame:
    """Findings per partition and severity with subtotals."""
    return f.rollup("partition", "severity").agg(
        F.count("*").alias("n"), F.count_if(F.col("is_suspicious")).alias("suspicious")
    )
