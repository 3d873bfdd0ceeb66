"""Interval helpers and window operators against brute force, with a hot key and ties."""

import random

import pytest
from pyspark.sql import functions as F

from tracehound.operators import windows
from tracehound.operators.intervals import count_ahead, distinct_ahead, nearest_value, next_within, previous_value, row_blocks, running_last, stab_count
from tracehound.schema import MINUTE, SECOND


def sample(seed, n=400, span=5_000):
    rng = random.Random(seed)
    # half of all rows belong to one key
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", f"u{rng.randrange(12)}", rng.randrange(span)) for _ in range(n)]


@pytest.mark.parametrize("width", [1, 37, 700])
def test_count_and_distinct_ahead(spark, width):
    rows = sample(width)
    df = spark.createDataFrame(rows, "k STRING, u STRING, us BIGINT")
    counts = {(r.k, r.us): r.n for r in count_ahead(df, ["k"], "us", width).collect()}
    users = {(r.k, r.us): r.n for r in distinct_ahead(df, ["k"], "u", "us", width).collect()}
    for k, us in {(k, t) for k, _, t in rows}:
        inside = [u for kk, u, t in rows if kk == k and us <= t <= us + width]
        assert counts[(k, us)] == len(inside)
        assert users[(k, us)] == len(set(inside))


def test_stab_count_weights(spark):
    spans = spark.createDataFrame([("a", 0, 9, 2), ("a", 5, 14, 3), ("b", 5, 5, 1)], "k STRING, lo BIGINT, hi BIGINT, weight INT")
    asks = spark.createDataFrame([("a", t) for t in (0, 5, 9, 10, 14, 15)] + [("b", 5), ("b", 6)], "k STRING, at BIGINT")
    got = {(r.k, r.at): r.n for r in stab_count(spans, asks, ["k"], 10).collect()}
    assert [got[("a", t)] for t in (0, 5, 9, 10, 14)] == [2, 5, 5, 3, 3]
    assert got.get(("a", 15), 0) == 0 and got[("b", 5)] == 1 and got.get(("b", 6), 0) == 0


def test_next_within_is_strict(spark):
    left = spark.createDataFrame([("l1", 0), ("l2", 100), ("l3", 150)], "id STRING, us BIGINT")
    right = spark.createDataFrame([("r0", 0), ("r1", 60), ("r2", 100), ("r3", 159), ("r4", 159)], "rid STRING, us BIGINT")
    got = {r.id: (r.next_us, r.next_id) for r in next_within(left, right, "us", 60, "rid").collect()}
    assert got == {"l2": (159, "r3"), "l3": (159, "r3")}  # l1 -> r1 is 60 away, which is not less than 60


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_previous_and_running_last(spark, width):
    rng = random.Random(width)
    rows = [("hot" if i % 2 else f"s{i % 7}", i, rng.choice([None, None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, v BIGINT")
    prev = {(r.k, r.i): r.p for r in previous_value(df, ["k"], "i", "i", width, "p").collect()}
    last = {(r.k, r.i): r.p for r in running_last(df, ["k"], "i", F.col("v"), width, "p").collect()}
    for k, i, _ in rows:
        before = [j for kk, j, _ in rows if kk == k and j < i]
        seen = [v for kk, j, v in rows if kk == k and j <= i and v is not None]
        assert prev[(k, i)] == (max(before) if before else None)
        assert last[(k, i)] == (seen[-1] if seen else None)


@pytest.mark.parametrize("bits", [3, 20])
@pytest.mark.parametrize("gap", [20, 400])
def test_anchored_windows_brute_force(spark, bits, gap):
    rng = random.Random(gap)
    rows, t = [], {"hot": 0, "b": 7, "c": 90_000_000}
    for _ in range(600):
        k = rng.choice(["hot", "hot", "b", "c"])
        t[k] += rng.randrange(1, gap) * SECOND
        rows.append((k, t[k]))
    df = spark.createDataFrame(rows, "k STRING, us BIGINT")
    got = {(r.k, r.us): r.window_us for r in windows.anchored_windows(df, ["k"], 1, bits=bits).collect()}
    for key in t:
        start = None
        for us in sorted({u for k, u in rows if k == key}):
            if start is None or us - start > MINUTE:
                start = us
            assert got[(key, us)] == start


@pytest.mark.parametrize("times", [[i * 97_000 for i in range(600)], [0, 1, 5 * MINUTE, 90 * 86400 * SECOND, 90 * 86400 * SECOND + MINUTE, 91 * 86400 * SECOND]])
def test_anchored_windows_without_keys(spark, times):
    """All events in one minute, and a gap of months."""
    got = {r.us: r.window_us for r in windows.anchored_windows(spark.createDataFrame([(t,) for t in times], "us BIGINT"), [], 1).collect()}
    start = None
    for t in times:
        start = t if start is None or t - start > MINUTE else start
        assert got[t] == start


def test_anchored_windows_of_a_crowded_moment(spark):
    """A million times in one window, and windows on both sides; blocks hold at most 2^14 rows, and no Python runs."""
    crowd = spark.range(1_000_000).select((F.col("id") * 59 + 10 * MINUTE).alias("us"))
    around = spark.createDataFrame([(t,) for t in (0, 30 * SECOND, 10 * MINUTE - 1, 11 * MINUTE - 1, 11 * MINUTE, 12 * MINUTE, 13 * MINUTE + 1)], "us BIGINT")
    out = windows.anchored_windows(crowd.unionByName(around), [], 1, bits=14)
    assert "Python" not in out._jdf.queryExecution().toString()
    first = 10 * MINUTE - 1
    want = {0: 0, 30 * SECOND: 0, first: first, first + MINUTE: first, first + MINUTE + 1: first + MINUTE + 1, 12 * MINUTE: 11 * MINUTE, 13 * MINUTE + 1: 13 * MINUTE + 1}
    by = {r.window_us: r["count"] for r in out.groupBy("window_us").count().collect()}
    assert by[0] == 2 and by[first] == 1_000_002 and by[11 * MINUTE] == 2 and by[13 * MINUTE + 1] == 1 and sum(by.values()) == 1_000_007
    got = {r.us: r.window_us for r in out.where(F.col("us").isin(list(want))).collect()}
    assert all(got[t] == w for t, w in want.items() if t in got)


def test_row_blocks_and_nearest_values(spark):
    r = random.Random(8)
    rows = [(r.choice(["hot", "hot", "a", None]), i, r.randrange(99) if r.random() < 0.2 else None) for i in range(300)]
    blocks = row_blocks(spark.createDataFrame(rows, "k STRING, i BIGINT, v BIGINT").repartition(4), ["k", "i"], 3)
    assert blocks.groupBy("_block").count().agg(F.max("count")).first()[0] <= 8
    for ahead in (False, True):
        got = {r.i: r.x for r in nearest_value(blocks, ["k"], F.col("v"), "x", ahead).collect()}
        for k, i, _ in rows:
            near = [(abs(j - i), v) for kk, j, v in rows if kk == k and v is not None and (j >= i if ahead else j <= i)]
            assert got[i] == (min(near)[1] if near else None)


def auth(spark, rows):
    """rows: (id, ip, user, second, outcome)"""
    df = spark.createDataFrame([(i, ip, u, float(s), o) for i, ip, u, s, o in rows], "id STRING, ip STRING, u STRING, s DOUBLE, outcome STRING")
    return df.select(
        "id", "outcome", F.timestamp_micros((F.col("s") * SECOND).cast("bigint")).alias("ts"), F.struct(F.col("ip").alias("ip"), F.lit(1).alias("port")).alias("source"),
        F.struct(F.col("u").alias("name")).alias("user"), F.array(F.lit("auth")).alias("tags"), F.lit("ssh_auth").alias("log_type"),
    )


def test_bruteforce_threshold_and_edge(spark):
    nine = [(f"a{i}", "1.1.1.1", "bob", i, "failure") for i in range(9)]
    edge = [(f"b{i}", "2.2.2.2", "eve", i * 300 / 9, "failure") for i in range(10)]  # the tenth is exactly five minutes after the first
    late = [(f"c{i}", "3.3.3.3", "eve", i * 300.1 / 9, "failure") for i in range(10)]
    e = auth(spark, nine + edge + late)
    got = windows.bruteforce(e, 10, 5).collect()
    assert [(r.ip, r.user, r.failures, r.start_us, r.end_us) for r in got] == [("2.2.2.2", "eve", 10, 0, 300 * SECOND)]
    assert windows.bruteforce_events(e, windows.bruteforce(e, 10, 5)).count() == 10


def test_spray_counts_users_once(spark):
    rows = [(f"x{i}", "1.1.1.1", f"u{i % 9}", i, "failure") for i in range(40)]
    assert windows.password_spray(auth(spark, rows), 10, 10).count() == 0
    got = windows.password_spray(auth(spark, rows + [("y", "1.1.1.1", "u9", 50, "failure")]), 10, 10).collect()
    assert [(r.ip, r.users, r.start_us) for r in got] == [("1.1.1.1", 10, 0)]


def test_success_after_failures_is_strict(spark):
    rows = [("f1", "1.1.1.1", "bob", 0, "failure"), ("f2", "2.2.2.2", "bob", 10, "failure"), ("f3", "2.2.2.2", "bob", 600, "failure")]
    e = auth(spark, rows + [("s1", "3.3.3.3", "bob", 600, "success"), ("s2", "3.3.3.3", "bob", 600.5, "success")])
    assert windows.success_after_failures(e, 3, 10).collect() == []  # s1: same time does not count; s2: f1 is too old
    two = windows.success_after_failures(e, 2, 10)
    assert {r.id: r.failures for r in two.collect()} == {"s1": 2, "s2": 2}
    assert {(r.id, r.ip) for r in windows.failing_sources(e, two, 10).collect()} == {("s1", "1.1.1.1"), ("s1", "2.2.2.2"), ("s2", "2.2.2.2")}


def test_burst_is_less_than_a_minute(spark):
    rows = [(f"a{i}", "1.1.1.1", "u", i * 6, "failure") for i in range(10)] + [(f"b{i}", "2.2.2.2", "u", i * 60 / 9, "failure") for i in range(10)]
    assert [(r.ip, r.events) for r in windows.burst(auth(spark, rows), 10, 60).collect()] == [("1.1.1.1", 10)]
