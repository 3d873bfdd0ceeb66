"""Chains and their precedence, scores, models, streams, plans."""


import pytest
from pyspark.sql import functions as F

from tracehound.operators import correlate, detect, forensics, isolation, learn, query, stats
from tracehound.plans import jobs, views
from tracehound.schema import SECOND
from tracehound.streaming import jobs as st


def slim(spark, rows):
    """rows: (id, second, log_source, ip, user, outcome, message)"""
    df = spark.createDataFrame(rows, "id STRING, s BIGINT, log_source STRING, ip STRING, u STRING, outcome STRING, message STRING")
    return df.select(
        "id", F.timestamp_micros(F.col("s") * SECOND).alias("ts"), "log_source", F.concat("log_source", F.lit("_t")).alias("log_type"), F.lit("info").alias("severity"), "outcome", "message",
        F.col("message").alias("raw_line"), F.lit("x").alias("action"), F.struct(F.col("ip").alias("ip")).alias("source"), F.struct(F.col("u").alias("name")).alias("user"),
        F.struct(F.lit("h").alias("hostname")).alias("destination"),
    )


def test_kill_chain_is_dropped_when_it_shares_an_event(spark):
    base = [(f"w{i}", i, "web", "1.1.1.1", "bob", "unknown", "GET /?q=1' or 1=1 union select") for i in range(3)]
    lone = [("w9", 500, "web", "2.2.2.2", "eve", "unknown", "GET /c99.php"), ("d9", 510, "database", "3.3.3.3", "db", "unknown", "query")]
    got = correlate.correlate(slim(spark, base + lone))
    chains = {r.chain_id for r in got["chains"].collect()}
    # the IP chain comes first; the web-shell pattern takes w9, which no earlier chain holds
    assert "ip:1.1.1.1" in chains and "kill:webshell" in chains and "kill:sql_injection" not in chains
    kinds = {r.role for r in got["links"].where("chain_id = 'ip:1.1.1.1'").collect()}
    assert kinds == {"ip", "user"}


def test_accept_kill_chains_fold(spark):
    ddl = "chain_id STRING, priority INT, event_id STRING, us BIGINT"
    kill = spark.createDataFrame([("a", 3, "e1", 1), ("b", 4, "e1", 1), ("b", 4, "e2", 2), ("c", 5, "e2", 2), ("d", 6, "e9", 9)], ddl)
    covered = spark.createDataFrame([("x", 1, "e9", 9)], ddl)
    # b falls to a, so c may stay although it shares an event with b; d falls to an earlier chain
    assert {r.chain_id for r in correlate.accept_kill_chains(kill, covered).collect()} == {"a", "c"}


def test_empty_input_gives_fixed_advice(spark):
    got = correlate.correlate(slim(spark, [("a", 1, "web", "1.1.1.1", "u", "unknown", "hello")]))
    assert [r.recommendation for r in got["recommendations"].collect()] == ["No anomalies detected in the provided logs"]


def test_keyword_and_category_ties(spark):
    e = spark.createDataFrame([("1", "Invalid user and <script>", "ssh_auth"), ("2", "authentication failure", "ssh_auth"), ("3", "fine", "ssh_auth")], "id STRING, message STRING, log_type STRING").withColumn("severity", F.lit("info"))
    tags = {r.id: (r.attack_type, r.severity) for r in detect.tag_keywords(e).collect()}
    assert tags == {"1": ("xss_attack", "warning"), "2": ("bruteforce", "warning"), "3": ("safe", "info")}
    cat = {r.id: (r.attack_type, r.attack_confidence) for r in detect.tag_by_category(e).collect()}
    assert cat["2"] == ("bruteforce", 0.85) and cat["3"] == (None, None)


def test_vote_and_layer_bands(spark):
    i = spark.createDataFrame([(0, 1, "a", v) for v in (3, 2)] + [(0, 2, "b", v) for v in (2, 2, 2)] + [(0, 3, "c", 1)], "partition INT, record_no BIGINT, filename STRING, votes INT")
    assert {r.record_no: r.severity for r in forensics.vote(i).collect()} == {1: "HIGH", 2: "CRITICAL", 3: "INFO"}


def test_forest_finds_the_outlier_in_any_partitioning(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(500)] + [(1000, 90.0, -80.0)]
    df = spark.createDataFrame(rows, "id BIGINT, a DOUBLE, b DOUBLE")
    one = isolation.fit(df.coalesce(1), ["a", "b"], "id", 0.01, n_trees=20, size=64)
    two = isolation.fit(df.repartition(7), ["a", "b"], "id", 0.01, n_trees=20, size=64)
    s1 = {r.id: round(r.raw_score, 9) for r in one.score(df).collect()}
    s2 = {r.id: round(r.raw_score, 9) for r in two.score(df).collect()}
    assert s1 == s2 and max(s1, key=s1.get) == 1000
    assert isolation.fit(df.limit(9), ["a", "b"], "id", 0.1) is None


def test_baseline_survives_saving(spark, tmp_path, sf):
    e = views.entries(spark, sf)
    base = learn.fit_baseline(e)
    base.save(str(tmp_path / "m"))
    back = learn.Baseline.load(spark, str(tmp_path / "m"))
    same = lambda b: {r.id: round(r.anomaly_score, 9) for r in b.score(e.limit(200)).collect()}
    assert same(base) == same(back)


def test_text_model_learns_a_clear_signal(spark):
    words = {"bruteforce": "failed password for root", "normal": "session opened fine", "xss_attack": "script alert cookie"}
    rows = [(i, f"{words[k]} node{i % 9}", k) for i, k in enumerate(list(words) * 60)]
    df = spark.createDataFrame(rows, "id BIGINT, message STRING, attack_type STRING")
    m = learn.train_text(df, "id", iterations=20)
    assert m.accuracy > 0.95
    p = learn.predict(m.classifier.transform(m.vectorizer.transform(df)), m.classifier)
    assert p.where("is_attack AND predicted = 'normal'").count() == 0


def test_flatten_takes_any_names(spark):
    e = spark.range(20).select(F.col("id").cast("string").alias("id"), F.create_map(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit("v")).alias("fields"))
    wide = query.flatten_fields(e, [f"k{i}" for i in range(1001)])
    assert len(wide.columns) == 1003 and query.field_cells(e).count() == 20
    assert [r.fields_k3 for r in wide.orderBy(F.col("id").cast("int")).collect()] == ["-"] * 3 + ["v"] + ["-"] * 16


def test_long_chains_and_messages_are_whole(spark):
    """Sixty events of a chain are all covered, a word at character 5,000 is tagged, a file has eleven paths."""
    rows = [(f"w{i:02}", i, "web", "1.1.1.1", "bob", "unknown", "GET /?q=1' or 1=1 union select") for i in range(60)]
    s = correlate.slim(slim(spark, rows))
    covered = correlate.chain_events(s, correlate.ip_attack_chain(s), "ip")
    assert covered.count() == 60 and correlate.uncovered(s, covered).count() == 0
    from tracehound.operators import parsing

    lines = spark.createDataFrame([("a", 0, "x" * 5000 + " authentication failure")], "source STRING, line_no BIGINT, line STRING")
    assert detect.tag_keywords(parsing.to_entries(parsing.parse(lines, 2024))).first().attack_type == "bruteforce"
    files = spark.createDataFrame([("c:/a/report.doc",)], "filename STRING")
    paths = spark.createDataFrame([("report.doc", f"c:/{i}/report.doc") for i in range(11)], "name STRING, path STRING")
    assert forensics.file_paths(files, paths).count() == 11


def test_intermediate_tables_prune_columns(spark, sf):
    from tracehound import session

    cut = session.cut_lineage(views.entries(spark, sf))
    scan = _plan(cut.select("severity")).split("ReadSchema")[1]
    assert "severity" in scan and "message" not in scan
    assert session.clear_intermediate(spark) >= 1


def test_stream_over_many_batches_equals_batch(spark, sf, tmp_path):
    e = views.entries(spark, sf).orderBy("ts")
    e.repartitionByRange(6, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = st.run_available(st.success_after_failures(stream, 2, 24 * 60, "40 days"), "update", "t4")  # files come in any order
    got = {(r.id, r.failures) for r in st.newest(out, ["id"], "failures").collect()}
    want = {(r.id, r.failures) for r in __import__("tracehound.operators.windows", fromlist=["x"]).success_after_failures(e, 2, 24 * 60).collect()}
    assert got and got == want
    tags = st.run_available(detect.tag_keywords(stream).select("id", "attack_type"), name="t1")
    assert {tuple(r) for r in tags.collect()} == {tuple(r) for r in detect.tag_keywords(e).select("id", "attack_type").collect()}


def test_parse_job_counts(spark, sf):
    got = jobs.parse_job(views.raw_lines(spark, sf), 2024)
    n = got["entries"].count()
    assert n == 1000 and got["counts"].where("dimension = 'severity'").agg(F.sum("n")).first()[0] == n
    assert got["entries"].where("ts IS NULL").count() < n / 3


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_are_distributed(spark, sf):
    from tracehound.operators import windows

    e = views.entries(spark, sf)
    checks = {
        "bruteforce": windows.bruteforce(e), "spray": windows.password_spray(e), "saf": windows.success_after_failures(e), "profile": stats.ip_profile(e),
        "sqli": correlate.sqli_pairs(correlate.slim(e)), "layered": forensics.layered_score(
            views.file_records(spark, sf), views.journal(spark, sf), views.transaction_log(spark, sf), views.windows_events(spark, sf), 2026),
    }
    for name, df in checks.items():
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
        assert "Python" not in plan, name
    top = _plan(query.first_per_group(e.withColumn("ip", F.col("source.ip")), ["ip"], ["ts", "id"], 10))
    assert "WindowGroupLimit" in top and "Partial" in top
    scan = _plan(stats.unique_counts(e))
    assert "props" not in scan.split("ReadSchema")[1]  # only the columns the query needs are read


QUICK = ["c3_query_counts", "e1_count_by", "e8_ip_profile", "f1_bruteforce", "f2_password_spray", "f3_success_after_failures", "r1_tag_keywords", "k1_ip_chains", "b1_line_type", "b4_group_entries", "m4_usn_causality", "m20_timeline_rules", "s1_stream_tags"]


@pytest.mark.parametrize("name", QUICK)
def test_catalogue_against_duckdb(spark, sf, name):
    import __spark_entry__ as entry
    from oracle_check import compare, connect

    assert compare(entry.queries()[name](spark, sf).toPandas(), connect(sf).execute(entry.oracle_sql()[name]).df()) is None


def test_vocabulary_over_words_and_pairs_together(spark):
    from tracehound.operators import learn

    rows = [(1, "The cat sat, the cat ran"), (2, "the cat sat"), (3, "a dog sat on the cat"), (4, "nothing else")]
    df = spark.createDataFrame(rows, "id BIGINT, message STRING")
    got = [(r.term, r.n, r.docs) for r in learn.vocabulary(df, "id", 4, max_df=0.8).collect()]
    assert got == [("cat", 4, 3), ("the", 4, 3), ("the cat", 4, 3), ("sat", 3, 3)]
    assert [r.term for r in learn.vocabulary(df, "id", 9, max_df=0.5).collect()] == ["cat sat"]
    assert learn.vocabulary(df.limit(0), "id").count() == 0


def test_cut_off_of_a_sketch(spark):
    from tracehound.operators import isolation

    scored = spark.range(50_000).select((F.col("id") / 50_000).alias("raw_score"))
    for share in (0.01, 0.05, 0.3):
        cut, sketch = isolation.cut_off(scored, share)
        assert abs(scored.where(F.col("raw_score") > cut).count() / 50_000 - share) < 0.002 and sketch
    # Rows are scored once: the frame that comes back reads what was written.
    wide = spark.range(600).select(F.col("id"), (F.col("id") % 17).cast("double").alias("a"), F.when(F.col("id") < 3, 99.0).otherwise((F.col("id") % 5).cast("double")).alias("b"))
    forest, out = isolation.fit_score(wide, ["a", "b"], "id", 0.05)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert {0, 1, 2} <= {r.id for r in out.where("is_anomaly").collect()} and abs(out.where("is_anomaly").count() / 600 - 0.05) < 0.02
    assert forest.threshold == isolation.fit(wide, ["a", "b"], "id", 0.05).threshold
    assert isolation.fit_score(wide.limit(5), ["a", "b"], "id", 0.05) is None


def test_lines_of_one_task_are_parsed_by_all(spark):
    """A file that gives one task does not leave the parsing, tagging and writing of all lines to it."""
    lines = spark.range(0, 4000, 1, 1).select(F.lit("h").alias("source"), F.col("id").alias("line_no"), F.lit("Failed password for u from 1.2.3.4 port 22").alias("line"))
    got = jobs.parse_job(lines, 2024)["entries"].groupBy(F.input_file_name()).count().collect()
    assert len(got) >= 8 and sum(r["count"] for r in got) == 4000 and max(r["count"] for r in got) <= 1000
