"""How often inputs are read, how work is dealt, and that results stay what a plain computation gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracehound.operators import forensics as fx
from tracehound.operators import isolation, learn
from tracehound.plans import views
from tracehound.streaming import jobs as st


@pytest.fixture()
def counted(spark):
    """A frame whose texts are counted whenever they are read."""

    def make(df, column="message"):
        seen = spark.sparkContext.accumulator(0)

        def read(x):
            seen.add(1)
            return x

        return df.withColumn(column, F.udf(read, "string")(column)), seen

    return make


def texts(spark, n=120):
    words = {"normal": "login accepted session opened", "anomaly": "failed denied refused error", "spam_activity": "buy cheap offer now"}
    rows = [(i, f"{words[k]} w{i % 7} x{i % 3}", k, "en" if i % 2 else "de") for i in range(n) for k in [list(words)[i % 3]]]
    return spark.createDataFrame(rows, "id BIGINT, message STRING, attack_type STRING, category STRING").repartition(3)


def test_text_models_read_texts_twice_and_once_for_all_categories(spark, counted):
    df, seen = counted(texts(spark))
    base = learn.train_text(df, "id", iterations=5)
    assert seen.value <= 2 * 120 and base.f1 > 0.9
    before = seen.value
    models = learn.train_by_category(df, "id", "category", base)
    assert sorted(models) == ["de", "en"] and seen.value - before <= 120
    assert base.predict(texts(spark)).where("confidence > 0.34").count() == 120
    assert all(m.predict(texts(spark)).count() == 120 and m.f1 > 0.9 for m in models.values())


def test_train_features_computes_features_once(spark, sf, counted):
    e = views.entries(spark, sf).withColumn("attack_type", F.when(F.col("line_no") % 8 == 1, "sql_injection").otherwise("safe"))
    df, seen = counted(e, "raw_line")
    model, accuracy = learn.train_features(df, folds=2, trees=3, depth=4)
    assert 0 < seen.value <= e.count() and accuracy > 0.9
    ready = learn.attack_features(e)
    again, same = learn.train_features(ready, folds=2, trees=3, depth=4)
    assert same > 0.9 and learn.decode(again.transform(ready), again).where("predicted = attack_type").count() > 0.9 * e.count()


def test_baseline_reads_texts_twice(spark, sf, counted):
    e = views.entries(spark, sf)
    df, seen = counted(e)
    base = learn.fit_baseline(df)
    n = e.count()
    assert 0 < seen.value <= 2 * n
    assert base.score(e).where("is_anomaly IS NOT NULL").count() == n


def test_forest_scores_are_those_of_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    rows = spark.createDataFrame(pd.DataFrame({"id": range(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    forest = isolation.grow(rows, ["a", "b", "c"], "id", n_trees=8, size=64)
    got = isolation.raw_scores(rows, forest).orderBy("id").toPandas()["raw_score"].to_numpy()
    trees = {t: g.set_index("node") for t, g in forest.trees.toPandas().groupby("tree")}
    for i in range(0, 400, 25):
        total = 0.0
        for g in trees.values():
            node, depth = 0, 0
            while g.loc[node, "feature"] >= 0:
                node, depth = int(g.loc[node, "low" if x[i, int(g.loc[node, "feature"])] < g.loc[node, "cut"] else "high"]), depth + 1
            total += depth + float(isolation.average_path(float(g.loc[node, "size"])))
        assert got[i] == pytest.approx(2.0 ** (-total / len(trees) / float(isolation.average_path(64.0))))


def test_presence_keeps_flags_and_no_sets(spark):
    make = lambda *names: spark.createDataFrame([(n,) for n in names], "name STRING")
    out = fx.presence({"A": make("X", "x", "y", None), "B": make("x", "y", None), "C": make("x", None, "z")}, least=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {(r["name"], r["sources"], tuple(r["found_in"])) for r in out.collect()} == {("x", 3, ("A", "B", "C")), ("y", 2, ("A", "B")), (None, 3, ("A", "B", "C"))}
    assert dict(out.dtypes)["sources"] == "bigint"
    assert "collect_set" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_micro_batch_is_several_files(spark, tmp_path):
    sizes, parts = [400, 0, 7, 90], [6, 1, 2, 9]
    frames = [spark.range(1000 * k, 1000 * k + n, numPartitions=p).toDF("id") for k, (n, p) in enumerate(zip(sizes, parts))]
    stream = st.as_stream(frames, str(tmp_path / "in"))
    seen = {}
    q = stream.writeStream.foreachBatch(lambda b, i: seen.__setitem__(i, sorted(r["id"] for r in b.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == {k: list(range(1000 * k, 1000 * k + n)) for k, n in enumerate(sizes)}
    rows = spark.read.parquet(str(tmp_path / "in/0000")).groupBy(F.input_file_name()).count().toPandas()["count"]
    assert len(rows) == 6 and rows.max() < 400
