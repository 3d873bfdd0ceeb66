"""Streams of several micro-batches with late and repeated rows, beside batch results."""

import pytest
from pyspark.sql import functions as F

from tracehound.plans.views import entries
from tracehound.streaming import jobs as st

D = "/root/testdata/sf0.001"
BASE = 1_000_000  # a stream begins with a watermark at zero


def auth(spark, rows):
    """rows: (id, ip, user, port, second, outcome)"""
    df = spark.createDataFrame(rows, "id STRING, ip STRING, u STRING, port INT, s BIGINT, outcome STRING")
    return df.select(
        "id", "outcome", F.timestamp_seconds(F.col("s") + BASE).alias("ts"), F.struct("ip", "port").alias("source"), F.struct(F.col("u").alias("name")).alias("user"),
        F.array(F.lit("auth")).alias("tags"), F.lit("ssh_auth").alias("log_type"),
    )


def as_files(frames, folder):
    return st.as_stream(frames, str(folder))


def test_resent_rows(spark, tmp_path):
    one, two, three, four = (auth(spark, [(i, "a", "u", 1, s, "failure") for i, s in rows]) for rows in ([("x", 0), ("y", 10)], [("z", 400)], [("x", 0), ("z", 400)], [("w", 9000)]))
    out = st.run_available(st.drop_resent(as_files([one, two, three, four, four.withColumn("id", F.lit("v")), auth(spark, [(i, "a", "u", 1, 9000, "failure") for i in "xw"])], tmp_path / "in").select("id", "ts"), "10 minutes"), name="t6")
    # A copy two batches later goes; the same id is a new entry once a batch has ended behind the delay, which forgets it.
    assert sorted((r.id, int(r.ts.timestamp()) - BASE) for r in out.collect()) == [("v", 9000), ("w", 9000), ("x", 0), ("x", 9000), ("y", 10), ("z", 400)]


def test_replay_equals_the_table(spark):
    e = entries(spark, D).select("id", "ts", "outcome")
    plain = st.run_available(st.replayed(e, 5).select("id"), name="t7")
    assert plain.count() == e.count() == plain.distinct().count()
    again = st.replayed(e, 5, again=2)
    twice = st.run_available(again.select("id"), name="t8")
    assert twice.count() > e.count()
    assert st.run_available(st.drop_resent(again, "90 days").select("id"), name="t9").count() == e.count()


def test_exact_counts_of_a_busy_address(spark, tmp_path):
    scan = spark.range(10_000).select(
        F.concat(F.lit("p"), "id").alias("id"), F.lit("failure").alias("outcome"), F.timestamp_seconds(BASE + F.col("id") % 200).alias("ts"), F.struct(F.lit("hot").alias("ip"), F.col("id").cast("int").alias("port")).alias("source"),
        F.struct(F.concat(F.lit("u"), F.col("id") % 3_333).alias("name")).alias("user"), F.array(F.lit("auth")).alias("tags"), F.lit("ssh_auth").alias("log_type"))
    late = auth(spark, [("q1", "hot", "u1", 5, 10, "failure"), ("q2", "hot", "new", 70_000, 20, "success"), ("q3", "calm", None, None, 30, "failure")])
    counts = st.run_available(st.window_counts(as_files([scan.where("id < 'p5'"), scan.where("id >= 'p5'"), late], tmp_path / "in"), "1 hour", "5 minutes", "5 minutes"), "update", "t3")
    got = {(r.ip, r.type): r.hits for r in st.alerts_of(counts, failures=1, events=1).collect()}
    assert got == {("hot", "bruteforce"): 10_001, ("hot", "password_spray"): 3_333, ("hot", "port_scan"): 10_001, ("hot", "burst"): 10_002, ("calm", "bruteforce"): 1, ("calm", "burst"): 1}


def test_alerts_of_changed_windows(spark, tmp_path):
    frames = [auth(spark, [(f"{b}{k}", ip, f"u{k}", k, b * 60 + k, "failure") for ip in ("a", "b")[: b + 1] for k in range(6)]) for b in range(3)]
    stream = st.window_counts(as_files(frames, tmp_path / "in"), "1 hour", "10 minutes", "10 minutes", parts=3)
    with st.rocksdb(spark):
        stream.writeStream.outputMode("update").foreachBatch(st.alert_batches(str(tmp_path / "out"), failures=10, users=6, ports=6, events=99)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    by = {}
    for r in spark.read.parquet(str(tmp_path / "out/alerts")).collect():
        by.setdefault(r.batch, set()).add((r.ip, r.type, r.hits))
    scan = lambda ip: {(ip, "password_spray", 6), (ip, "port_scan", 6)}
    assert by[0] == scan("a") and by[1] == scan("a") | scan("b") | {("a", "bruteforce", 12)} and by[2] >= {("a", "bruteforce", 18), ("b", "bruteforce", 12)}


@pytest.mark.parametrize("buckets", [1, 64])
def test_success_after_failures_over_late_batches(spark, tmp_path, buckets):
    first = auth(spark, [("s1", "a", "u", 1, 1000, "success"), ("f1", "a", "u", 1, 500, "failure"), ("s2", "a", "v", 1, 700, "success")])
    late = auth(spark, [("f2", "a", "u", 1, 999, "failure"), ("f3", "a", "u", 1, 1000, "failure"), ("f4", "a", "v", 1, 100, "failure"), ("f5", "a", "v", 1, 100, "failure"), ("f6", "a", "v", 1, 99, "failure")])
    last = auth(spark, [("f7", "a", "u", 1, 400, "failure"), ("s3", "a", "u", 1, 1600, "success"), ("s4", None, "w", 1, 1600, "success")])
    out = st.run_available(st.success_after_failures(as_files([first, late, last], tmp_path / "in"), 2, 10, "1 hour", buckets=buckets), "update", "t4")
    newest = {(r.id, r.user): r.failures for r in st.newest(out, ["id", "user"], "failures").collect()}
    # s1: 400, 500, 999; s2: 100 twice, 99 is a second too old; s3: 1000 only counts, 999 is too old
    assert newest == {("s1", "u"): 3, ("s2", "v"): 2}
