"""Order-dependent operators: sliding thresholds, anchored windows, bursts, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.operators.intervals import BLOCK_BITS, count_ahead, distinct_ahead, nearest_value, previous_value, row_blocks, stab_count
from tracehound.schema import MINUTE, SECOND, is_auth_event, micros
from tracehound.session import cut_lineage, intermediate_mark, keep_last


def auth_failures(e: DataFrame) -> DataFrame:
    """Failed authentication events with a known IP and user."""
    return e.where(
        (F.col("outcome") == "failure") & F.col("source.ip").isNotNull() & F.col("user.name").isNotNull()
        & is_auth_event()
    ).select("id", F.col("source.ip").alias("ip"), F.col("user.name").alias("user"), micros().alias("us"))


def _first_window(counts: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    return (
        counts.where(F.col("n") >= threshold)
        .groupBy(*keys)
        .agg(F.min(F.struct("us", "n")).alias("w"))
        .select(*keys, F.col("w.us").alias("start_us"), F.col("w.n").alias("n"))
    )


def _window_end(events: DataFrame, found: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Time of the last event inside each found window; one found window per key."""
    ends = (
        events.groupBy(*keys, "us").count()
        .join(found, keys)
        .where((F.col("us") >= F.col("start_us")) & (F.col("us") <= F.col("start_us") + width))
        .groupBy(*keys).agg(F.max("us").alias("end_us"))
    )
    return found.join(ends, keys)


def bruteforce(e: DataFrame, n: int = 10, minutes: float = 5) -> DataFrame:
    """Per (IP, user): the first window of ``minutes`` that holds ``n`` failed logins or more."""
    width, keys = int(minutes * MINUTE), ["ip", "user"]
    fails = auth_failures(e)
    found = _first_window(count_ahead(fails, keys, "us", width), keys, n)
    return _window_end(fails, found, keys, width).withColumnRenamed("n", "failures")


def bruteforce_events(e: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events behind each brute-force alert, one row per event."""
    return (
        auth_failures(e).join(alerts.select("ip", "user", "start_us", "end_us"), ["ip", "user"])
        .where("us BETWEEN start_us AND end_us").select("ip", "user", "id", "us")
    )


def password_spray(e: DataFrame, n: int = 10, minutes: float = 10) -> DataFrame:
    """Per IP: the first window of ``minutes`` with failed logins of ``n`` different users or more."""
    width, keys = int(minutes * MINUTE), ["ip"]
    fails = auth_failures(e)
    found = _first_window(distinct_ahead(fails, keys, "user", "us", width), keys, n)
    return _window_end(fails, found, keys, width).withColumnRenamed("n", "users")


def spray_users(e: DataFrame, alerts: DataFrame) -> DataFrame:
    """Users of each spray window, one row per user."""
    return (
        auth_failures(e).join(alerts.select("ip", "start_us", "end_us"), "ip")
        .where("us BETWEEN start_us AND end_us").select("ip", "user").distinct()
    )


def _auth_by_user(e: DataFrame) -> DataFrame:
    return e.where(F.col("user.name").isNotNull() & is_auth_event()).select(
        "id", F.col("user.name").alias("user"), F.col("source.ip").alias("ip"), "outcome", micros().alias("us")
    )


def success_after_failures(e: DataFrame, n: int = 3, minutes: float = 10) -> DataFrame:
    """Each success with ``n`` failures or more of the same user in the ``minutes`` strictly before it."""
    width = int(minutes * MINUTE)
    auth = _auth_by_user(e)
    wins = auth.where("outcome = 'success'").select("id", "user", "us")
    spans = (
        auth.where("outcome = 'failure'").groupBy("user", "us").agg(F.count("*").alias("weight"))
        .select("user", (F.col("us") + 1).alias("lo"), (F.col("us") + width).alias("hi"), "weight")
    )
    counts = stab_count(spans, wins.select("user", "us"), ["user"], width, at="us", out="failures")
    return wins.join(counts.where(F.col("failures") >= n), ["user", "us"])


def failing_sources(e: DataFrame, alerts: DataFrame, minutes: float = 10) -> DataFrame:
    """IPs that failed before each alerted success, one row per (success, IP).

    Failures of one (user, IP) inside one slice of the window width cover one unbroken span, so a success
    meets each IP twice at most and the join grows with its output only.
    """
    width = int(minutes * MINUTE)
    spans = (
        _auth_by_user(e).where("outcome = 'failure' AND ip IS NOT NULL")
        .withColumn("_slice", F.floor(F.col("us") / width))
        .groupBy("user", "ip", "_slice").agg((F.min("us") + 1).alias("lo"), (F.max("us") + width).alias("hi"))
    )
    asked = alerts.select("id", "user", F.col("us").alias("at")).withColumn(
        "_slice", F.explode(F.array(F.floor(F.col("at") / width), F.floor(F.col("at") / width) - 1))
    )
    return (
        asked.join(spans, ["user", "_slice"])
        .where("at BETWEEN lo AND hi").select("id", "ip").distinct()
    )


def burst(e: DataFrame, n: int = 10, seconds: float = 60) -> DataFrame:
    """Per IP: events less than ``seconds`` after the IP's first event, when there are ``n`` or more."""
    width = int(seconds * SECOND)
    per_time = (
        e.where(F.col("source.ip").isNotNull())
        .groupBy(F.col("source.ip").alias("ip"), micros().alias("us")).agg(F.count("*").alias("c"))
    )
    first = per_time.groupBy("ip").agg(F.min("us").alias("start_us"))
    return (
        per_time.join(first, "ip").where(F.col("us") - F.col("start_us") < width)
        .groupBy("ip").agg(F.sum("c").alias("events"), F.min("start_us").alias("start_us"), F.max("us").alias("end_us"))
        .where(F.col("events") >= n)
    )


def burstiness(e: DataFrame, keys: list[str], slice_hours: float = 6) -> DataFrame:
    """Deviation of the gaps between events over their mean, at most 2; 0 for five events or fewer.

    Gaps need the event before only, which comes from the slice helper; equal times give zero gaps, so the
    moments follow from the gaps between distinct times and the counts.
    """
    per_time = e.groupBy(*keys, micros().alias("us")).agg(F.count("*").alias("c"))
    gaps = previous_value(per_time, keys, "us", "us", int(slice_hours * 60 * MINUTE), "prev")
    gap = (F.col("us") - F.col("prev")) / 1000.0
    stats = gaps.groupBy(*keys).agg(
        F.sum("c").alias("events"), F.sum(gap).alias("s1"), F.sum(gap * gap).alias("s2"),
    )
    k = F.col("events") - 1
    mean = F.coalesce(F.col("s1"), F.lit(0.0)) / k
    var = F.greatest(F.coalesce(F.col("s2"), F.lit(0.0)) / k - mean * mean, F.lit(0.0))
    value = F.when(
        F.col("events") > 5, F.least(F.sqrt(var) / F.when(mean == 0, F.lit(1.0)).otherwise(mean), F.lit(2.0))
    ).otherwise(0.0)
    return stats.select(*keys, "events", value.alias("burstiness"))


def zscore_outliers(df: DataFrame, col: str, limit: float = 3.0) -> DataFrame:
    """Rows more than ``limit`` population deviations away from the mean."""
    x = F.col(col).cast("double")
    stats = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    mean, dev = stats.select("m").scalar(), stats.select("s").scalar()
    z = F.abs(x - mean) / dev
    return df.withColumn("zscore", F.when(dev > 0, z)).where(F.col("zscore") > limit)


def lsn_order(log: DataFrame, width: int = 1 << 40) -> DataFrame:
    """Transaction-log records whose time falls below that of the record before, per file."""
    from tracehound.rules.dims import FILE_REF_MASK

    rows = log.where("ts IS NOT NULL AND file_ref IS NOT NULL").select(
        F.col("file_ref").bitwiseAND(F.lit(FILE_REF_MASK)).alias("record_no"), "lsn", micros().alias("us")
    )
    marked = previous_value(rows.withColumn("pair", F.struct("us", "lsn")), ["record_no"], "lsn", "pair", width, "before", ("us",))
    return marked.where(F.col("us") < F.col("before.us")).select(
        "record_no", F.col("before.lsn").alias("prev_lsn"), F.col("before.us").alias("prev_us"), "lsn", "us"
    )


def lsn_gaps(log: DataFrame, gap: int = 1_000_000, width: int = 1 << 32) -> DataFrame:
    """Jumps between neighbouring log sequence numbers larger than ``gap``, per partition."""
    rows = log.where("lsn > 0").select("partition", "lsn").distinct()
    return previous_value(rows, ["partition"], "lsn", "lsn", width, "from_lsn").where(
        F.col("lsn") - F.col("from_lsn") > gap
    ).select("partition", "from_lsn", F.col("lsn").alias("to_lsn"), (F.col("lsn") - F.col("from_lsn")).alias("gap_size"))


def clock_rollback(events: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Places where time falls from one record number to the next, per channel."""
    rows = events.where("ts IS NOT NULL").select("channel", "record_id", micros().alias("us"))
    return previous_value(rows, ["channel"], "record_id", "us", width, "prev_us").where(
        F.col("us") < F.col("prev_us")
    ).select("channel", "record_id", "prev_us", "us", ((F.col("prev_us") - F.col("us")) / SECOND).alias("rollback_seconds"))


# --- anchored windows ---------------------------------------------------------------------------------


def _same(keys: list[str], left: str, right: str) -> Column:
    """Null-safe equality of (keys, left) with (_keys, right)."""
    out = F.col(left) == F.col(right)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def successors(times: DataFrame, keys: list[str], width: int, bits: int) -> DataFrame:
    """(keys, us, to): the first time of the keys more than ``width`` after each distinct time, where there is one.

    Times and the ends of their windows are put in one order; what follows an end is its successor.
    """
    home = times.select(*keys, F.col("us").alias("pos"), F.lit(0).alias("is_end"))
    ends = times.select(*keys, (F.col("us") + width).alias("pos"), F.lit(1).alias("is_end"))
    blocks = row_blocks(home.unionByName(ends), [*keys, "pos", "is_end"], bits)
    ahead = nearest_value(blocks, keys, F.when(F.col("is_end") == 0, F.col("pos")), "to", ahead=True)
    return ahead.where("is_end = 1 AND to IS NOT NULL").select(*keys, (F.col("pos") - width).alias("us"), "to")


def anchored_windows(e: DataFrame, keys: list[str], minutes: float, us: str = "us", bits: int = BLOCK_BITS) -> DataFrame:
    """Distinct event times with the start of their window.

    The first event opens a window, events up to ``minutes`` after the opener join it, the next one opens another.
    Without keys the windows run over all events. Each time has a successor, the time that would open the next
    window after it; openers are what the first time reaches. Successors are doubled (2, 4, 8 windows on) until none is
    left, and openers are filled in from the longest steps to the shortest. Only times that are themselves so many
    windows behind another are carried from step to step, so the tables shrink as chains run together; there are as many
    steps as the logarithm of the number of windows. Work is by time and by blocks of 2^bits rows, never by window.
    """
    spark, width = e.sparkSession, int(minutes * MINUTE)
    times = cut_lineage(e.select(*keys, F.col(us).alias("us")).distinct())
    first = cut_lineage(times.groupBy(*keys).agg(F.min("us").alias("us")))
    mark = intermediate_mark()
    renamed = lambda df, *cols: df.select(*[F.col(k).alias(f"_{k}") for k in keys], *cols)

    def within(jump: DataFrame) -> DataFrame:
        """Steps from the first times, and from times that a step of this length leads to."""
        met = renamed(first.unionByName(jump.select(*keys, F.col("to").alias("us"))).distinct(), F.col("us").alias("_met"))
        return cut_lineage(jump.join(met, _same(keys, "us", "_met"), "left_semi"))

    steps = [within(cut_lineage(successors(times, keys, width, bits)))]
    while not steps[-1].join(renamed(first, F.col("us").alias("_met")), _same(keys, "us", "_met"), "left_semi").isEmpty():
        further = renamed(steps[-1], F.col("us").alias("_from"), F.col("to").alias("_far"))
        steps.append(within(steps[-1].join(further, _same(keys, "to", "_from")).select(*keys, "us", F.col("_far").alias("to"))))
    openers = first
    for step in reversed(steps[:-1]):
        landed = step.join(renamed(openers, F.col("us").alias("_met")), _same(keys, "us", "_met"), "left_semi").select(*keys, F.col("to").alias("us"))
        openers = cut_lineage(openers.unionByName(landed).distinct())
    opened = renamed(openers, F.col("us").alias("_met"), F.lit(True).alias("_opens"))
    marked = times.join(opened, _same(keys, "us", "_met"), "left").select(*keys, "us", F.when(F.col("_opens"), F.col("us")).alias("_opener"))
    out = cut_lineage(nearest_value(row_blocks(marked, [*keys, "us"], bits), keys, F.col("_opener"), "window_us", ahead=False).select(*keys, "us", "window_us"))
    keep_last(spark, mark)
    return out


def _failures_in_windows(e: DataFrame, minutes: float) -> DataFrame:
    timed = e.where("ts IS NOT NULL").withColumn("us", micros())
    # only failures are grouped, but every event takes part in opening windows
    spans = anchored_windows(timed, [], minutes)
    fails = timed.where((F.col("outcome") == "failure") & F.col("source.ip").isNotNull()).groupBy(
        F.col("source.ip").alias("ip"), F.coalesce(F.col("user.name"), F.lit("")).alias("user"), "us"
    ).agg(F.count("*").alias("c"))
    return fails.join(spans, "us")


def bruteforce_chain(e: DataFrame, n: int = 5, minutes: float = 5, span_minutes: float = 10) -> DataFrame:
    """Per window and (IP, user): ``n`` failures or more within the span."""
    return (
        _failures_in_windows(e, minutes).groupBy("window_us", "ip", "user")
        .agg(F.sum("c").alias("failures"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
        .where((F.col("failures") >= n) & (F.col("end_us") - F.col("start_us") <= int(span_minutes * MINUTE)))
        .withColumn("confidence", F.least(F.lit(0.7) + F.col("failures") / 50, F.lit(0.95)))
    )


def spray_chain(e: DataFrame, n: int = 10, minutes: float = 5, span_minutes: float = 15) -> DataFrame:
    """Per window and IP: failures of ``n`` different users or more within the span."""
    return (
        _failures_in_windows(e, minutes).groupBy("window_us", "ip")
        .agg(
            F.countDistinct(F.nullif(F.col("user"), F.lit(""))).alias("users"), F.min("us").alias("start_us"),
            F.max("us").alias("end_us"),
        )
        .where((F.col("users") >= n) & (F.col("end_us") - F.col("start_us") <= int(span_minutes * MINUTE)))
        .withColumn("confidence", F.least(F.lit(0.7) + F.col("users") / 50, F.lit(0.95)))
    )
