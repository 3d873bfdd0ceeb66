"""Chains across sources. Events, IPs, users and hosts of a chain are rows of a link table, never one big cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.scalars import advice, attack_stage, correlation_score, event_title
from tracehound.operators.detect import add_mitre, tag_ordered
from tracehound.operators.intervals import next_within
from tracehound.operators.stats import chain_ip_threats, summary_api, summary_basic, summary_enhanced, threat_scores, user_profile
from tracehound.operators.windows import bruteforce_chain, burst, spray_chain
from tracehound.rules import attacks, dims
from tracehound.schema import SECOND, is_attack, micros, union_all
from tracehound.session import cut_lineage

IP_PRIORITY, USER_PRIORITY, KILL_PRIORITY, BURST_PRIORITY = 1, 2, 3, 9


def ip_chains(e: DataFrame) -> DataFrame:
    """IPs with two tags, two anomalies, or one of each."""
    src, odd = F.col("source.ip"), F.coalesce("is_anomaly", F.lit(False))
    tagged = F.col("attack_type").isNotNull() & (F.col("attack_type") != "safe")
    g = e.where(src.isNotNull() & (src != "LOCAL")).groupBy(src.alias("ip")).agg(
        F.count("*").alias("events"), F.count_if(tagged).alias("tags"), F.count_if(odd).alias("anomalies"),
        F.array_sort(F.collect_set(F.when(tagged, F.col("attack_type")))).alias("types"),
        F.countDistinct("log_type").alias("services"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
    )
    return g.where((F.col("tags") >= 2) | (F.col("anomalies") >= 2) | ((F.col("tags") >= 1) & (F.col("anomalies") >= 1))).select(
        F.concat(F.lit("ip:"), "ip").alias("chain_id"), "ip",
        F.coalesce(F.get("types", F.lit(0)), F.lit("behavioral_outlier")).alias("attack_type"),
        F.when(F.size("types") > 1, "execution").otherwise("reconnaissance").alias("stage"), "events", "services",
        (F.lit(0.75) + F.least(F.col("events"), F.lit(10)) * 0.02).alias("confidence"), "start_ts", "end_ts",
    )


def distributed_bruteforce(e: DataFrame, ips: int = 3, failures: int = 5) -> DataFrame:
    return user_profile(e).where((F.col("ips") >= ips) & (F.col("failures") >= failures)).select(
        "user", "ips", "failures", F.lit(0.85).alias("confidence"), "start_ts", "end_ts"
    )


def account_compromise(e: DataFrame, many: int = 10) -> DataFrame:
    """Users with a success from a failing IP, or any success after more than ``many`` failures."""
    p = user_profile(e).where((F.col("failures") > 0) & (F.col("successes") > 0))
    return p.where((F.col("shared_ips") > 0) | (F.col("failures") > many)).select(
        "user", "ips", "failures", "successes", "shared_ips", F.lit(0.9).alias("confidence"), "start_ts", "end_ts"
    )


def suspicious_timeline(e: DataFrame) -> DataFrame:
    """Tagged or anomalous entries in time order."""
    tagged = F.coalesce(F.col("attack_type") != "safe", F.lit(False))
    return e.where(tagged | F.coalesce("is_anomaly", F.lit(False))).select(
        "id", "ts", "log_source", F.coalesce("attack_type", F.lit("anomaly")).alias("event_type"), "severity",
        F.concat(F.lit("Suspicious activity in "), "log_type").alias("title"),
        F.col("message").alias("description"), F.col("source.ip").alias("source_ip"),
        F.col("user.name").alias("target_user"), F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
    ).orderBy("ts", "id")


# --- chains with an order of precedence -----------------------------------------------------------------


def slim(e: DataFrame) -> DataFrame:
    """The columns the chains need, with the ordered tag."""
    tagged = tag_ordered(e)
    return tagged.where("ts IS NOT NULL").select(
        "id", "ts", micros().alias("us"), "log_type", "log_source", "severity", "action", "outcome", "message",
        F.col("source.ip").alias("ip"), F.col("user.name").alias("usr"), F.col("destination.hostname").alias("host"),
        F.col("attack_type").alias("tag"), F.col("attack_confidence").alias("tag_confidence"),
    )


def _key_chains(s: DataFrame, key: str, kind: str, stage: str, priority: int, least: int) -> DataFrame:
    """Chains of one key column: enough events, at least one tag; the type is that of the first tagged event."""
    first = F.when(F.col("tag").isNotNull(), F.struct("us", "id", "tag", "tag_confidence"))
    g = s.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("events"), F.min(first).alias("first"), F.min("us").alias("start_us"), F.max("us").alias("end_us"),
    )
    return g.where((F.col("events") >= least) & F.col("first").isNotNull()).select(
        F.concat(F.lit(f"{kind}:"), key).alias("chain_id"), F.lit(kind).alias("kind"), F.col(key).alias("key"),
        F.col("first.tag").alias("attack_type"), F.lit(stage).alias("stage"), "start_us", "end_us", "events",
        F.col("first.tag_confidence").alias("confidence"), F.lit(priority).alias("priority"),
    )


def chain_events(s: DataFrame, chains: DataFrame, key: str) -> DataFrame:
    """All events of each chain of a key column."""
    rows = s.select("id", "us", F.col(key).alias("key")).join(chains.select("key", "chain_id", "priority"), "key")
    return rows.select("chain_id", "priority", F.col("id").alias("event_id"), "us")


def ip_attack_chain(s: DataFrame, least: int = 3) -> DataFrame:
    return _key_chains(s, "ip", "ip", "execution", IP_PRIORITY, least)


def uncovered(s: DataFrame, covered: DataFrame, least: int = 3) -> DataFrame:
    """Entries outside the events of earlier chains, for users with ``least`` such entries or more."""
    rest = s.join(covered.select(F.col("event_id").alias("id")).distinct(), "id", "left_anti")
    busy = rest.where("usr IS NOT NULL").groupBy("usr").count().where(F.col("count") >= least).select("usr")
    return rest.join(busy, "usr", "left_semi")


def user_attack_chain(rest: DataFrame, least: int = 3) -> DataFrame:
    return _key_chains(rest, "usr", "user", "initial_access", USER_PRIORITY, least)


def sqli_pairs(s: DataFrame, seconds: int = 60) -> DataFrame:
    """Each web request with SQL-like text and the first database event less than ``seconds`` after it."""
    like_sql = F.lit(False)
    for word in attacks.SQL_WORDS:
        like_sql = like_sql | F.contains(F.lower("message"), F.lit(word))
    web = s.where((F.col("log_source") == "web") & like_sql).select("id", "us", "ip")
    db = s.where(F.col("log_source") == "database").select("us", F.col("id").alias("db_id"))
    return next_within(web, db, "us", seconds * SECOND, "db_id")


def sqli_chain(s: DataFrame, seconds: int = 60) -> DataFrame:
    """The first such pair as a chain."""
    best = sqli_pairs(s, seconds).agg(F.min(F.struct("us", "id", "ip", "next_us", "next_id")).alias("b")).where("b IS NOT NULL")
    return best.select(
        F.lit("kill:sql_injection").alias("chain_id"), F.col("b.ip").alias("key"), F.lit("sql_injection").alias("attack_type"),
        F.lit("execution").alias("stage"), F.col("b.us").alias("start_us"), F.col("b.next_us").alias("end_us"),
        F.lit(2).cast("bigint").alias("events"), F.lit(0.85).alias("confidence"), F.col("b.id").alias("web_id"), F.col("b.next_id").alias("db_id"),
    )


def account_takeover(s: DataFrame, failures: int = 5) -> DataFrame:
    """Users of the auth logs with enough failures, a success and a known failing IP."""
    fail, win = F.col("outcome") == "failure", F.col("outcome") == "success"
    g = s.where((F.col("log_source") == "auth") & F.col("usr").isNotNull()).groupBy("usr").agg(
        F.count_if(fail).alias("failures"), F.count_if(win).alias("successes"), F.countDistinct(F.when(fail, F.col("ip"))).alias("failing_ips"),
        F.min(F.when(fail, F.col("us"))).alias("start_us"), F.min(F.when(win, F.col("us"))).alias("end_us"),
        F.min(F.struct("us", "id")).alias("first"),
    )
    return g.where((F.col("failures") >= failures) & (F.col("successes") > 0) & (F.col("failing_ips") >= 1))


def _one_chain(rows: DataFrame, name: str, stage: str, confidence: float, least: int) -> DataFrame:
    g = rows.agg(F.count("*").alias("events"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.countDistinct("ip").alias("ips"), F.countDistinct("usr").alias("users"))
    return g.where(F.col("events") >= least).select(
        F.lit(f"kill:{name}").alias("chain_id"), F.lit(name).alias("attack_type"), F.lit(stage).alias("stage"),
        "start_us", "end_us", "events", "ips", "users", F.lit(confidence).alias("confidence"),
    )


def admin_logins(s: DataFrame) -> DataFrame:
    return s.where((F.col("log_source") == "auth") & (F.col("outcome") == "success") & F.lower("usr").rlike("|".join(attacks.ADMIN_WORDS)))


def privileged_access(s: DataFrame) -> DataFrame:
    return _one_chain(admin_logins(s), "privilege_escalation", "privilege_escalation", 0.75, 1)


def ransomware_events(s: DataFrame) -> DataFrame:
    return s.where((F.col("log_source") == "system") & F.col("message").rlike(attacks.RANSOMWARE))


def ransomware(s: DataFrame, least: int = 2) -> DataFrame:
    return _one_chain(ransomware_events(s), "ransomware", "complete", 0.9, least)


def webshell_events(s: DataFrame) -> DataFrame:
    return s.where((F.col("log_source") == "web") & F.col("message").rlike(attacks.WEBSHELL))


def webshell(s: DataFrame) -> DataFrame:
    return _one_chain(webshell_events(s), "webshell", "persistence", 0.8, 1)


def auth_bruteforce(s: DataFrame, failures: int = 5) -> DataFrame:
    """IPs of the auth logs with enough failures."""
    g = s.where((F.col("log_source") == "auth") & (F.col("outcome") == "failure") & F.col("ip").isNotNull()).groupBy("ip").agg(
        F.count("*").alias("failures"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min(F.struct("us", "id")).alias("first"),
    )
    return g.where(F.col("failures") >= failures)


def _first_key(found: DataFrame, key: str) -> DataFrame:
    """The key whose first event comes first."""
    return found.agg(F.min_by(key, F.col("first")).alias(key)).where(F.col(key).isNotNull())


def kill_chain_events(s: DataFrame, seconds: int = 60) -> DataFrame:
    """Events of the six kill-chain patterns, (chain_id, priority, event_id, us); each pattern once."""
    def of(rows: DataFrame, name: str, order: int) -> DataFrame:
        return rows.select(
            F.lit(f"kill:{name}").alias("chain_id"), F.lit(KILL_PRIORITY + order).alias("priority"), F.col("id").alias("event_id"), "us"
        )

    sqli = sqli_chain(s, seconds).select(F.inline(F.array(
        F.struct(F.col("web_id").alias("event_id"), F.col("start_us").alias("us")),
        F.struct(F.col("db_id").alias("event_id"), F.col("end_us").alias("us")),
    ))).select(F.lit("kill:sql_injection").alias("chain_id"), F.lit(KILL_PRIORITY).alias("priority"), "event_id", "us")
    auth = s.where("log_source = 'auth' AND outcome IN ('failure', 'success')")
    takeover = auth.join(F.broadcast(_first_key(account_takeover(s), "usr")), "usr", "left_semi")
    fails = s.where("log_source = 'auth' AND outcome = 'failure'")
    brute = fails.join(F.broadcast(_first_key(auth_bruteforce(s), "ip")), "ip", "left_semi")
    locked = ransomware_events(s)
    enough = locked.agg(F.count("*").alias("n")).scalar()
    return union_all([
        sqli, of(takeover, "account_takeover", 1), of(admin_logins(s), "privilege_escalation", 2),
        of(locked.where(enough >= 2), "ransomware", 3), of(webshell_events(s), "webshell", 4), of(brute, "bruteforce", 5),
    ])


KILL_STAGE = {
    "sql_injection": ("execution", 0.85), "account_takeover": ("initial_access", 0.9),
    "privilege_escalation": ("privilege_escalation", 0.75), "ransomware": ("complete", 0.9),
    "webshell": ("persistence", 0.8), "bruteforce": ("reconnaissance", 0.85),
}


def accept_kill_chains(kill: DataFrame, covered: DataFrame) -> DataFrame:
    """Kill chains that share no event with an earlier chain, whether of IPs, users or another kill chain.

    An event is in six chains at most, and six chains take part, so precedence is one fold over a six-element array.
    """
    hits = kill.join(covered.select("event_id").distinct(), "event_id", "left_semi").select("chain_id").distinct().withColumn("blocked", F.lit(True))
    a, b = kill.alias("a"), kill.alias("b")
    shared = a.join(b, F.col("a.event_id") == F.col("b.event_id")).where("a.priority < b.priority").select(
        F.col("b.chain_id").alias("chain_id"), F.col("a.priority").alias("p")
    ).distinct().groupBy("chain_id").agg(F.collect_set("p").alias("rivals"))
    rows = kill.select("chain_id", "priority").distinct().join(hits, "chain_id", "left").join(shared, "chain_id", "left")
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("priority", F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("rivals", F.array().cast("array<int>")).alias("rivals")))).alias("c"))
    folded = ordered.select(F.explode(F.aggregate(
        "c", F.array().cast("array<int>"),
        lambda acc, x: F.when(x["blocked"] | F.arrays_overlap(acc, x["rivals"]), acc).otherwise(F.array_append(acc, x["priority"])),
    )).alias("priority"))
    return kill.join(F.broadcast(folded), "priority", "left_semi")


def burst_chains(e: DataFrame, n: int = 10, seconds: float = 60) -> DataFrame:
    return burst(e, n, seconds).select(
        F.concat(F.lit("burst:"), "ip").alias("chain_id"), F.lit("burst").alias("kind"), F.col("ip").alias("key"), F.lit("ddos").alias("attack_type"),
        F.lit("execution").alias("stage"), "start_us", "end_us", "events", F.lit(0.7).alias("confidence"), F.lit(BURST_PRIORITY).alias("priority"),
    )


def drop_overlapping(chains: DataFrame, events: DataFrame, covered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains none of whose events are covered, and their events."""
    taken = events.join(covered.select("event_id").distinct(), "event_id", "left_semi").select("chain_id").distinct()
    return chains.join(taken, "chain_id", "left_anti"), events.join(taken, "chain_id", "left_anti")


def correlate_attacks(e: DataFrame, least: int = 3) -> DataFrame:
    """IPs with ``least`` tagged entries or more: mean confidence, type of the first."""
    g = e.where(is_attack() & F.col("source.ip").isNotNull()).groupBy(F.col("source.ip").alias("ip")).agg(
        F.count("*").alias("attacks"), F.avg("attack_confidence").alias("confidence"), F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"), F.min_by("attack_type", F.struct("ts", "id")).alias("attack_type"),
    )
    return g.where(F.col("attacks") >= least)


def basic_timeline(e: DataFrame, n: int | None = None) -> DataFrame:
    """Entries in time order with the anomaly flag; the first ``n`` of them if asked for."""
    out = e.where("ts IS NOT NULL").select(
        "id", "ts", F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"), "severity", "log_source",
        F.coalesce("action", "message").alias("title"), F.col("source.ip").alias("source_ip"),
    ).orderBy("ts", "id")
    return out if n is None else out.limit(n)


def first_chain(events: DataFrame, chains: DataFrame) -> DataFrame:
    """For each event of any chain: the first chain that holds it."""
    scored = events.join(chains.select("chain_id", "confidence"), "chain_id")
    return scored.groupBy("event_id").agg(F.min(F.struct("priority", "chain_id", "confidence")).alias("c")).select(
        F.col("event_id").alias("id"), F.col("c.chain_id").alias("chain_id"), F.col("c.confidence").alias("anomaly_score")
    )


def timeline(s: DataFrame, events: DataFrame, chains: DataFrame) -> DataFrame:
    """All entries in time order, each with the first chain that holds it."""
    out = s.join(first_chain(events, chains), "id", "left")
    return out.select(
        "id", "us", "log_source", F.col("log_type").alias("event_type"), "severity",
        event_title(F.col("ip"), F.col("action"), F.col("usr"), F.col("outcome"), F.col("severity")).alias("title"),
        F.col("message").alias("description"), F.col("ip").alias("source_ip"), F.col("usr").alias("target_user"),
        "chain_id", F.col("chain_id").isNotNull().alias("is_anomaly"), F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
    ).orderBy("us", "id")


def correlated_events(s: DataFrame, progress: Column | float = 0.0) -> DataFrame:
    return s.select(
        "id", "us", "log_source", "log_type", "severity", F.col("ip").alias("source_ip"), F.col("usr").alias("target_user"),
        F.col("host").alias("target_host"), "action", "outcome", "message",
        correlation_score(F.col("severity"), progress).alias("correlation_score"),
    )


def chain_stages(s: DataFrame, events: DataFrame, chains: DataFrame) -> DataFrame:
    """Stage of each chain from its type and what its events show."""
    seen = events.join(s.select(F.col("id").alias("event_id"), "outcome", "log_source"), "event_id").groupBy("chain_id").agg(
        F.bool_or(F.col("outcome") == "success").alias("w"), F.bool_or(F.col("outcome") == "failure").alias("f"), F.countDistinct("log_source").alias("n"),
    )
    return chains.join(seen, "chain_id").select("chain_id", "attack_type", attack_stage(F.col("attack_type"), F.col("w"), F.col("f"), F.col("n")).alias("stage"))


def recommendations(chains: DataFrame) -> DataFrame:
    """Distinct advice over all chains; one fixed line when there is no chain."""
    minutes = (F.col("end_us") - F.col("start_us")) / (60 * SECOND)
    lines = chains.select(F.explode(F.array_compact(F.array(
        advice(F.col("attack_type"), minutes),
        *[F.when(F.col("attack_type") == t, text) for t, text in dims.EXTRA_ADVICE.items()],
        F.when(F.col("stage") == "complete", dims.COMPLETED_ADVICE),
    ))).alias("recommendation")).distinct()
    some = lines.agg(F.count("*").alias("n")).scalar()
    none = chains.sparkSession.createDataFrame([(dims.NO_FINDING_ADVICE,)], "recommendation STRING").where(some == 0)
    return lines.unionByName(none).orderBy("recommendation")


def chain_links(s: DataFrame, rest: DataFrame, chains: DataFrame, events: DataFrame) -> DataFrame:
    """IPs, users and hosts of the chains, (chain_id, attack_type, role, value).

    IP chains list all users of the IP, user chains all IPs of the user's uncovered entries, the others what
    their events show.
    """
    c = chains.select("chain_id", "attack_type", "kind", "key")
    ip_users = s.select(F.col("ip").alias("key"), F.col("usr").alias("value")).distinct().join(c.where("kind = 'ip'"), "key").withColumn("role", F.lit("user"))
    user_ips = rest.select(F.col("usr").alias("key"), F.col("ip").alias("value")).distinct().join(c.where("kind = 'user'"), "key").withColumn("role", F.lit("ip"))
    own = c.where("kind IN ('ip', 'user', 'burst')").select(
        "chain_id", "attack_type", F.when(F.col("kind") == "user", "user").otherwise("ip").alias("role"), F.col("key").alias("value")
    )
    shown = events.join(c.where("kind = 'kill'"), "chain_id").join(s.select(F.col("id").alias("event_id"), "ip", "usr", "host"), "event_id").select(
        "chain_id", "attack_type", F.inline(F.array(
            F.struct(F.lit("ip").alias("role"), F.col("ip").alias("value")), F.struct(F.lit("user").alias("role"), F.col("usr").alias("value")),
            F.struct(F.lit("host").alias("role"), F.col("host").alias("value"))))
    )
    cols = ["chain_id", "attack_type", "role", "value"]
    return union_all([ip_users.select(cols), user_ips.select(cols), own.select(cols), shown.select(cols)]).where("value IS NOT NULL").distinct()


def correlate(e: DataFrame, burst_n: int = 10, burst_seconds: float = 60, sqli_seconds: int = 60, materialize: bool = True) -> dict[str, DataFrame]:
    """Full run: chains with their events and links, timeline, summary and advice.

    Precedence: IP chains, user chains over what is left, kill chains and bursts without a shared event.
    """
    s = slim(e)
    if materialize:
        s = cut_lineage(s)
    ips = ip_attack_chain(s)
    ip_events = chain_events(s, ips, "ip")
    rest = uncovered(s, ip_events)
    users = user_attack_chain(rest)
    events = ip_events.unionByName(chain_events(rest, users, "usr"))
    if materialize:
        events = cut_lineage(events)
    kill = kill_chain_events(s, sqli_seconds)
    if materialize:
        kill = cut_lineage(kill)
    kept = accept_kill_chains(kill, events)
    names = F.create_map(*[F.lit(x) for k, v in KILL_STAGE.items() for x in (k, f"{v[0]}|{v[1]}")])
    name = F.expr("substring(chain_id, 6)")
    kill_chains = kept.groupBy("chain_id", "priority").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("events")).select(
        "chain_id", F.lit("kill").alias("kind"), F.lit(None).cast("string").alias("key"), name.alias("attack_type"),
        F.split(F.element_at(names, name), r"\|")[0].alias("stage"), "start_us", "end_us", "events",
        F.split(F.element_at(names, name), r"\|")[1].cast("double").alias("confidence"), "priority",
    )
    events = events.unionByName(kept.select("chain_id", "priority", "event_id", "us"))
    if materialize:
        events = cut_lineage(events)
    bursts = burst_chains(e, burst_n, burst_seconds)
    inside = s.select("id", "us", F.col("ip").alias("key")).join(bursts.select("key", "chain_id", "priority", "end_us"), "key").where("us <= end_us")
    burst_events = inside.select("chain_id", "priority", F.col("id").alias("event_id"), "us")
    bursts, burst_events = drop_overlapping(bursts, burst_events, events)
    chains = union_all([ips, users, kill_chains, bursts])
    events = events.unionByName(burst_events)
    if materialize:
        chains, events = cut_lineage(chains), cut_lineage(events)
    links = chain_links(s, rest, chains, events)
    ip_links = links.where("role = 'ip'").withColumnRenamed("value", "ip")
    return {
        "chains": add_mitre(chains), "events": events, "links": links, "timeline": timeline(s, events, chains),
        "summary": summary_enhanced(e, chains, ip_links), "top_ips": chain_ip_threats(ip_links), "recommendations": recommendations(chains),
    }


def correlate_tagged(e: DataFrame) -> dict[str, DataFrame]:
    """Run over tagged entries without precedence: IP chains, targeted and compromised users, timeline, summary."""
    span = ["start_ts", "end_ts", "confidence"]
    ips = ip_chains(e).select(F.lit("ip_correlation").alias("kind"), F.col("ip").alias("key"), "attack_type", "stage", *span)
    spread = distributed_bruteforce(e).select(F.lit("user_targeting").alias("kind"), F.col("user").alias("key"), F.lit("distributed_bruteforce").alias("attack_type"), F.lit("credential_access").alias("stage"), *span)
    taken = account_compromise(e).select(F.lit("account_compromise").alias("kind"), F.col("user").alias("key"), F.lit("account_takeover").alias("attack_type"), F.lit("persistence").alias("stage"), *span)
    chains, line = union_all([ips, spread, taken]), suspicious_timeline(e)
    return {"chains": chains, "timeline": line, "summary": summary_api(chains, line)}


def correlate_windows(e: DataFrame, minutes: float = 5, span_minutes: float | None = None, failures: int = 5, users: int = 10) -> dict[str, DataFrame]:
    """Run over anchored windows: brute-force and spray chains, first timeline rows, summary, threatening IPs."""
    brute = bruteforce_chain(e, failures, minutes, span_minutes or 10).withColumn("attack_type", F.lit("bruteforce"))
    spray = spray_chain(e, users, minutes, span_minutes or 15).withColumn("attack_type", F.lit("password_spray"))
    chains = cut_lineage(union_all([brute, spray]))
    return {"chains": chains, "timeline": basic_timeline(e), "summary": summary_basic(e, chains), "top_ips": threat_scores(e, chains.select("ip", "confidence"))}
