"""Attack tags per entry and alerts from thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.functions import prefilter as pre
from tracehound.functions.normalize import category_of
from tracehound.operators import windows
from tracehound.operators.query import first_per_group
from tracehound.operators.stats import ip_profile
from tracehound.rules import attacks, dims
from tracehound.schema import computed, is_attack, union_all


def any_of(patterns: list[str]) -> str:
    """One case-blind pattern that hits wherever any of the patterns does."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def hits_any(patterns: list[str]) -> str:
    """`any_of` as an SQL condition, each pattern behind its own plain string tests."""
    return "(" + " OR ".join(pre.matches("(?i)" + p, pre.TEXT, pre.LOWERED) for p in patterns) + ")"


def _hits(patterns: list[str], shown: list[str]) -> str:
    """SQL array of the shown form of every pattern with a hit."""
    return "array_compact(array(" + ", ".join(f"CASE WHEN {pre.matches(p, pre.TEXT, pre.LOWERED)} THEN {pre.quoted(s)} END" for p, s in zip(patterns, shown)) + "))"


def tag_keywords(e: DataFrame, rules=attacks.KEYWORD_RULES) -> DataFrame:
    """Keyword tag by the heaviest rule with a hit; a tagged entry becomes a warning."""
    heaviest = "CASE " + " ".join(
        f"WHEN {hits_any(patterns)} THEN named_struct('attack_type', {pre.quoted(name)}, 'confidence', double({weight}))" for name, weight, patterns in sorted(rules, key=lambda r: -r[1])) + " END"
    bound, tag = pre.decided(e, F.coalesce("message", F.lit("")), heaviest)
    return computed(bound, _tag=tag).withColumns({
        "attack_type": F.coalesce(F.col("_tag.attack_type"), F.lit("safe")),
        "attack_confidence": F.coalesce(F.col("_tag.confidence"), F.lit(0.0)),
        "severity": F.when(F.col("_tag").isNotNull(), "warning").otherwise(F.col("severity")),
    }).drop("_tag", "_t")


def category_tag(rules=attacks.CATEGORY_RULES) -> str:
    """SQL of the best tag by the rules of the entry's category (`t.category`) only; equal confidence keeps the rule order."""
    by_category: dict[str, list] = {}
    for cat, name, weight, patterns in rules:
        by_category.setdefault(cat, []).append((name, weight, patterns))
    out = []
    for cat, items in by_category.items():
        tries = []
        for order, (name, weight, patterns) in enumerate(items):
            hits = _hits([attacks.category_pattern(p) for p in patterns], patterns)
            tag = f"named_struct('confidence', round(least(double({weight}) + size(h) * 0.1D, 0.95D), 6), 'rank', {-order}, 'attack_type', {pre.quoted(name)}, 'patterns', h)"
            tries.append(f"element_at(transform(array({hits}), h -> CASE WHEN size(h) > 0 THEN {tag} END), 1)")
        out.append(f"WHEN t.category = {pre.quoted(cat)} THEN array_max(array_compact(array({', '.join(tries)})))")
    return f"CASE {' '.join(out)} END"


def tag_by_category(e: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Category-aware tag with matched patterns, tactics and techniques; null below the threshold."""
    typed = computed(e, category=category_of(F.col("log_type")))
    bound, tag = pre.decided(typed, F.coalesce("message", F.lit("")), category_tag(), category=F.col("category"))
    tagged = computed(bound, _tag=tag)
    keep = F.col("_tag.confidence") >= threshold
    mitre = F.create_map(*[F.lit(x) for k, v in dims.TAG_MITRE.items() for x in (k, f"{v[0]}|{v[1]}")])
    codes = F.split(F.element_at(mitre, F.col("attack_type")), r"\|")
    return tagged.withColumns({
        "attack_type": F.when(keep, F.col("_tag.attack_type")),
        "attack_confidence": F.when(keep, F.col("_tag.confidence")),
        "matched_patterns": F.when(keep, F.col("_tag.patterns")),
    }).withColumns({
        "mitre_tactics": F.split(F.get(codes, F.lit(0)), ","), "mitre_techniques": F.split(F.get(codes, F.lit(1)), ","),
    }).drop("_tag", "_t")


def ordered_tag(rules=attacks.ORDERED_RULES) -> str:
    """SQL of the first type of the fixed order with a hit, with its confidence from the number of hits."""
    out = []
    for name, patterns in rules:
        hits = _hits(["(?i)" + p for p in patterns], patterns)
        tag = f"named_struct('attack_type', {pre.quoted(name)}, 'confidence', round(least(0.5D + h * 0.15D, 0.95D), 6), 'hits', h)"
        out.append(f"WHEN {hits_any(patterns)} THEN element_at(transform(array(size({hits})), h -> {tag}), 1)")
    return f"CASE {' '.join(out)} END"


def search_text() -> Column:
    parts = [F.lower(F.coalesce(c, F.lit(""))) for c in ("message", "raw_line", "action")]
    return F.concat_ws(" ", *parts)


def tag_ordered(e: DataFrame) -> DataFrame:
    bound, tag = pre.decided(e, search_text(), ordered_tag())
    return computed(bound, _tag=tag).withColumns({
        "attack_type": F.col("_tag.attack_type"), "attack_confidence": F.col("_tag.confidence"),
        "pattern_hits": F.col("_tag.hits"),
    }).drop("_tag", "_t")


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(c, t, w, len(p)) for c, t, w, p in attacks.CATEGORY_RULES]
    return spark.createDataFrame(rows, "category STRING, attack_type STRING, weight DOUBLE, n_patterns INT")


def types_for(log_types: DataFrame) -> DataFrame:
    """Attack types that apply to each log type of a frame with a ``log_type`` column."""
    cats = log_types.select("log_type").distinct().withColumn("category", category_of(F.col("log_type")))
    return cats.join(F.broadcast(rule_table(log_types.sparkSession)), "category")


def attack_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(dims.ATTACK_CATALOGUE.items()), "attack_type STRING, description STRING")


def chain_mitre_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, t, q) for k, (t, q) in dims.CHAIN_MITRE.items()]
    return spark.createDataFrame(rows, "attack_type STRING, mitre_tactics ARRAY<STRING>, mitre_techniques ARRAY<STRING>")


def add_mitre(df: DataFrame) -> DataFrame:
    """Tactics and techniques of the attack type, with the default for unknown types."""
    out = df.drop("mitre_tactics", "mitre_techniques").join(F.broadcast(chain_mitre_dim(df.sparkSession)), "attack_type", "left")
    tactics, techniques = dims.CHAIN_MITRE_DEFAULT
    return out.withColumns({
        "mitre_tactics": F.coalesce("mitre_tactics", F.array(*[F.lit(t) for t in tactics])),
        "mitre_techniques": F.coalesce("mitre_techniques", F.array(*[F.lit(t) for t in techniques])),
    })


def _alert_tactics(attack_type: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in dims.ALERT_TACTICS.items() for x in (k, "|".join(v))])
    return F.split(F.coalesce(F.element_at(pairs, attack_type), F.lit("Unknown")), r"\|")


def entry_alerts(e: DataFrame) -> DataFrame:
    """One alert per tagged entry."""
    return e.where(is_attack()).select(
        "id", F.col("attack_type").alias("type"), F.coalesce("severity", F.lit("high")).alias("severity"),
        F.coalesce("attack_confidence", F.lit(0.8)).alias("confidence"),
        F.concat(F.lit("Detected "), F.initcap(F.replace("attack_type", F.lit("_"), F.lit(" ")))).alias("title"),
        F.col("message").alias("description"), "ts", F.col("source.ip").alias("source_ip"),
        F.col("user.name").alias("target_user"), _alert_tactics(F.col("attack_type")).alias("mitre_tactics"),
    )


def anomaly_alerts(e: DataFrame, alerts: DataFrame) -> DataFrame:
    """One alert per anomalous entry that has none yet."""
    odd = e.where(F.coalesce("is_anomaly", F.lit(False))).join(alerts.select("id").distinct(), "id", "left_anti")
    return odd.select(
        "id", F.lit("anomaly").alias("type"), F.lit("medium").alias("severity"),
        F.coalesce("attack_confidence" if "attack_confidence" in e.columns else F.lit(0.5), F.lit(0.5)).alias("confidence"),
        F.lit("Behavioral Anomaly Detected").alias("title"),
        F.format_string("Unusual pattern detected in %s log (score: %.2f)", F.col("log_type"), F.coalesce("anomaly_score", F.lit(0.0))).alias("description"),
        "ts", F.col("source.ip").alias("source_ip"), F.col("user.name").alias("target_user"),
        _alert_tactics(F.lit("anomaly")).alias("mitre_tactics"),
    )


def port_scan(profile: DataFrame, ports: int = 10) -> DataFrame:
    return profile.where(F.col("ports") >= ports).select("ip", "ports", "last_ts")


def bruteforce_batch(profile: DataFrame, failures: int = 5, high: int = 15) -> DataFrame:
    return profile.where(F.col("failures") >= failures).select(
        "ip", "failures", F.when(F.col("failures") >= high, "high").otherwise("medium").alias("severity"), "last_ts"
    )


def credential_stuffing(profile: DataFrame, users: int = 3, failures: int = 5) -> DataFrame:
    return profile.where((F.col("users") >= users) & (F.col("failures") >= failures)).select("ip", "users", "failures", "last_ts")


def privilege_events(e: DataFrame) -> DataFrame:
    """Events of privilege use: tagged so, or a sudo or su action."""
    return e.where(F.array_contains("tags", "privilege_escalation") | F.col("action").isin("sudo", "su"))


def excess_privilege(e: DataFrame, more_than: int = 20) -> DataFrame:
    """Users with more than ``more_than`` privilege operations."""
    return (
        privilege_events(e).groupBy(F.coalesce(F.col("user.name"), F.lit("unknown")).alias("user"))
        .agg(F.count("*").alias("operations")).where(F.col("operations") > more_than)
    )


def privilege_related(e: DataFrame, alerts: DataFrame, k: int) -> DataFrame:
    """First ``k`` privilege events of each alerted user."""
    ev = privilege_events(e).select("id", "ts", F.coalesce(F.col("user.name"), F.lit("unknown")).alias("user"))
    return first_per_group(ev.join(alerts.select("user"), "user", "left_semi"), ["user"], ["ts", "id"], k)


@dataclass(frozen=True)
class DetectionConfig:
    bruteforce_n: int = 10
    bruteforce_minutes: float = 5
    spray_n: int = 10
    spray_minutes: float = 10
    success_n: int = 3
    success_minutes: float = 10
    ports: int = 10
    batch_failures: int = 5
    batch_high: int = 15
    stuffing_users: int = 3
    privilege_more_than: int = 20


def profile_alerts(e: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Port scan, batch brute force and credential stuffing from one profile of the IPs."""
    p = ip_profile(e)
    scan = F.when(F.col("ports") >= cfg.ports, F.struct(F.lit("port_scan").alias("type"), F.lit("medium").alias("severity"), F.lit(0.85).alias("confidence"), F.col("ports").alias("hits")))
    brute = F.when(F.col("failures") >= cfg.batch_failures, F.struct(
        F.lit("bruteforce").alias("type"), F.when(F.col("failures") >= cfg.batch_high, "high").otherwise("medium").alias("severity"),
        F.lit(0.9).alias("confidence"), F.col("failures").alias("hits")))
    stuff = F.when((F.col("users") >= cfg.stuffing_users) & (F.col("failures") >= cfg.batch_failures), F.struct(
        F.lit("credential_stuffing").alias("type"), F.lit("high").alias("severity"), F.lit(0.85).alias("confidence"), F.col("users").alias("hits")))
    return p.select("ip", "last_ts", F.inline(F.array_compact(F.array(scan, brute, stuff)))).select(
        F.concat_ws("-", F.replace("type", F.lit("_"), F.lit("-")), "ip").alias("id"), "type", "severity", "confidence",
        F.col("last_ts").alias("ts"), F.col("ip").alias("source_ip"), "hits",
    )


def run_detections(e: DataFrame, cfg: DetectionConfig = DetectionConfig(), tagged: DataFrame | None = None) -> DataFrame:
    """All rules over the entries as one alert table.

    ``tagged`` are the same entries with their tags; only their own alerts need them, so that the tag patterns do
    not run again below each window rule. Entries that hold a tag already need no second frame.
    """
    brute = windows.bruteforce(e, cfg.bruteforce_n, cfg.bruteforce_minutes).select(
        F.concat_ws("-", F.lit("window-bruteforce"), "ip", "user").alias("id"), F.lit("bruteforce").alias("type"),
        F.lit("high").alias("severity"), F.lit(0.9).alias("confidence"), F.timestamp_micros("end_us").alias("ts"),
        F.col("ip").alias("source_ip"), F.col("user").alias("target_user"), F.col("failures").alias("hits"),
    )
    spray = windows.password_spray(e, cfg.spray_n, cfg.spray_minutes).select(
        F.concat_ws("-", F.lit("window-spray"), "ip").alias("id"), F.lit("password_spray").alias("type"),
        F.lit("high").alias("severity"), F.lit(0.9).alias("confidence"), F.timestamp_micros("end_us").alias("ts"),
        F.col("ip").alias("source_ip"), F.col("users").alias("hits"),
    )
    success = windows.success_after_failures(e, cfg.success_n, cfg.success_minutes).select(
        F.concat_ws("-", F.lit("success-after-failures"), "id").alias("id"), F.lit("suspicious_activity").alias("type"),
        F.lit("medium").alias("severity"), F.lit(0.6).alias("confidence"), F.timestamp_micros("us").alias("ts"),
        F.col("user").alias("target_user"), F.col("failures").alias("hits"),
    )
    privilege = excess_privilege(e, cfg.privilege_more_than).select(
        F.concat_ws("-", F.lit("privilege"), "user").alias("id"), F.lit("privilege_escalation").alias("type"),
        F.lit("medium").alias("severity"), F.lit(0.3).alias("confidence"), F.col("user").alias("target_user"),
        F.col("operations").alias("hits"),
    )
    parts = [brute, spray, success, privilege, profile_alerts(e, cfg)]
    tagged = e if tagged is None and "attack_type" in e.columns else tagged
    if tagged is not None:
        parts.append(entry_alerts(tagged).withColumn("hits", F.lit(1).cast("bigint")))
    return union_all(parts)
