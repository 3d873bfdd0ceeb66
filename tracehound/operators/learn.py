"""Training, scoring, feedback and model versions on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF, CountVectorizer, CountVectorizerModel, IndexToString, NGram, OneHotEncoder, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.features import ATTACK_FEATURES, BEHAVIOUR_FEATURES, TABULAR_CATEGORIES, TABULAR_NUMBERS, attack_features, behaviour_features, tabular_features
from tracehound.functions.scalars import clip_unit, off_hours, sigmoid
from tracehound.operators import isolation
from tracehound.operators.windows import burstiness
from tracehound.rules import attacks
from tracehound.rules.weights import ATTACK_THRESHOLDS, ATTACK_WEIGHTS, FEATURE_RANGES
from tracehound.schema import MINUTE, micros
from tracehound.session import cut_lineage

# --- text models ----------------------------------------------------------------------------------------


def stratified_split(df: DataFrame, label: str, id_col: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, the same share of every label, decided per row by a hash of its id (MD5, which other engines state too)."""
    key = F.concat_ws(":", F.lit(str(seed)), F.col(label), F.col(id_col).cast("string"))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 10_000
    cut = int(test_share * 10_000)
    return df.where(u >= cut), df.where(u < cut)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Weight of each row so that all labels weigh the same; the label table is one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("t"), F.count("*").alias("k"))
    t, k = total.select("t").scalar(), total.select("k").scalar()
    return df.join(counts.withColumn("weight", t / (k * F.col("_n"))).drop("_n"), label)


def gram_stages(grams: int = 2) -> list:
    """Words of two characters or more, and sequences of up to ``grams`` of them, in one column ``grams``."""
    stages = [RegexTokenizer(inputCol="message", outputCol="w1", pattern=r"\w\w+", gaps=False)]
    stages += [NGram(n=n, inputCol="w1", outputCol=f"w{n}") for n in range(2, grams + 1)]
    every = ", ".join(f"w{n}" for n in range(1, grams + 1))
    return [*stages, SQLTransformer(statement=f"SELECT *, concat({every}) AS grams FROM __THIS__")]


def vocabulary(df: DataFrame, id_col: str, size: int = 500, grams: int = 2, min_df: float = 2, max_df: float = 0.95) -> DataFrame:
    """(term, n, docs): the ``size`` most frequent terms over words and sequences together, ties by term.

    Terms stand in ``min_df`` rows or more and in ``max_df`` of all rows at most. Counted by row first, so a term of a long
    text is one row before the shuffle; of each task only its own ``size`` best are ever compared.
    """
    rows = Pipeline(stages=gram_stages(grams)).fit(df).transform(df)
    # The outer kind: the plain one has Spark test the list for emptiness first, which cuts each text into words again.
    terms = rows.select(F.col(id_col).alias("_id"), F.explode_outer("grams").alias("term")).where("term IS NOT NULL")
    each = terms.groupBy("_id", "term").agg(F.count("*").alias("c"))
    total = df.agg(F.count("*").alias("n")).scalar()
    counts = each.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))
    kept = counts.where((F.col("docs") >= min_df) & (F.col("docs") <= F.lit(max_df) * total))
    return kept.orderBy(F.desc("n"), "term").limit(size)


def text_stages(terms: list[str], grams: int = 2) -> list:
    """Words and word sequences counted over a vocabulary of all of them, and weighted by rarity."""
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="grams", outputCol="counts")
    return [*gram_stages(grams), counter, IDF(inputCol="counts", outputCol="text_features")]


@dataclass
class TextModel:
    vectorizer: PipelineModel
    classifier: PipelineModel
    accuracy: float
    f1: float

    def predict(self, df: DataFrame) -> DataFrame:
        return named_prediction(self.classifier.transform(self.vectorizer.transform(df)))


def _classifier(features: str, reg: float, iterations: int) -> Pipeline:
    index = StringIndexer(inputCol="attack_type", outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc")
    lr = LogisticRegression(featuresCol=features, labelCol="label", weightCol="weight", maxIter=iterations, regParam=reg, family="multinomial")
    return Pipeline(stages=[index, lr])


def named_prediction(df: DataFrame) -> DataFrame:
    """Highest probability beside the prediction."""
    return df.withColumn("confidence", F.array_max(vector_to_array("probability")))


def _scores(pred: DataFrame) -> tuple[float, float]:
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    return ev.evaluate(pred, {ev.metricName: "accuracy"}), ev.evaluate(pred, {ev.metricName: "f1"})


def train_text(df: DataFrame, id_col: str, vectorizer: PipelineModel | None = None, grams: int = 2, reg: float = 0.01, iterations: int = 50, features: str = "text_features", extra: list | None = None, size: int = 500) -> TextModel:
    """Text classifier over (id, message, attack_type), balanced classes, stratified 80/20 split.

    With a given vectorizer the vocabulary is shared and only the classifier is fitted. Texts are cut into words once for the
    vocabulary and once for the counts, which are written: whatever is fitted or scored reads these. ``extra`` stages may
    read the category and the weighted counts.
    """
    if vectorizer is not None:
        return _fitted(vectorizer, cut_lineage(vectorizer.transform(df).select(id_col, "attack_type", features)), id_col, reg, iterations, features)
    train, _ = stratified_split(df, "attack_type", id_col)
    terms = [r["term"] for r in vocabulary(train, id_col, size, grams).collect()]  # `size` terms at most
    stages = text_stages(terms, grams)
    counter = PipelineModel(stages[:-1])
    kept = [c for c in dict.fromkeys((id_col, "attack_type", "category")) if c in df.columns]
    counted = cut_lineage(counter.transform(df).select(*kept, "counts"))
    weights = Pipeline(stages=stages[-1:] + (extra or [])).fit(stratified_split(counted, "attack_type", id_col)[0])
    return _fitted(PipelineModel([*counter.stages, *weights.stages]), weights.transform(counted), id_col, reg, iterations, features)


def _fitted(vec: PipelineModel, coded: DataFrame, id_col: str, reg: float, iterations: int, features: str) -> TextModel:
    """Classifier and its scores from rows that hold their features already."""
    train, test = stratified_split(coded, "attack_type", id_col)
    clf = _classifier(features, reg, iterations).fit(balanced(train, "attack_type"))
    accuracy, f1 = _scores(clf.transform(test))
    return TextModel(vec, clf, accuracy, f1)


def train_by_category(df: DataFrame, id_col: str, column: str, base: TextModel, least: int = 20) -> dict[str, TextModel]:
    """One classifier per category on the base vocabulary, with more regularisation; small or one-class categories are left out."""
    groups = df.groupBy(column).agg(F.count("*").alias("n"), F.countDistinct("attack_type").alias("k")).where((F.col("n") >= least) & (F.col("k") > 1))
    names = sorted(r[column] for r in groups.collect())  # one name per category, of which there are a few dozen
    coded = cut_lineage(base.vectorizer.transform(df).select(id_col, "attack_type", F.col(column).alias("_group"), "text_features"))  # texts are read once for all categories
    return {n: _fitted(base.vectorizer, coded.where(F.col("_group") == n), id_col, 0.02, 50, "text_features") for n in names}


def train_by_log_type(df: DataFrame, id_col: str, base: TextModel) -> dict[str, TextModel]:
    return train_by_category(df, id_col, "log_type", base, 20)


def train_unified(df: DataFrame, id_col: str) -> TextModel:
    """One classifier with the category as a further feature."""
    extra = [
        StringIndexer(inputCol="category", outputCol="cat", handleInvalid="keep"), OneHotEncoder(inputCols=["cat"], outputCols=["cat_vec"]),
        VectorAssembler(inputCols=["text_features", "cat_vec"], outputCol="unified_features"),
    ]
    return train_text(df, id_col, features="unified_features", extra=extra)


def train_features(e: DataFrame, folds: int = 3, trees: int = 100, depth: int = 10, seed: int = 42) -> tuple[PipelineModel, float]:
    """Random forest over the 25 attack features of labelled entries, scaled, with k-fold validation.

    Features are computed once and written, for each fold and the last fit read them several times; entries that hold all of
    them (``attack_features``) are taken as they are.
    """
    rows = e if set(ATTACK_FEATURES) <= set(e.columns) else cut_lineage(attack_features(e).select("attack_type", *ATTACK_FEATURES))
    stages = [
        VectorAssembler(inputCols=ATTACK_FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        StringIndexer(inputCol="attack_type", outputCol="label", stringOrderType="alphabetAsc"),
        RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed),
    ]
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    cv = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev, numFolds=folds, seed=seed)
    fitted = cv.fit(rows)
    return fitted.bestModel, float(fitted.avgMetrics[0])


def label_names(model: PipelineModel) -> list[str]:
    return next(s.labels for s in model.stages if hasattr(s, "labels"))


def decode(pred: DataFrame, model: PipelineModel, out: str = "predicted") -> DataFrame:
    return IndexToString(inputCol="prediction", outputCol=out, labels=[*label_names(model), "__unknown"]).transform(pred)


def predict(pred: DataFrame, model: PipelineModel, threshold: float = 0.3) -> DataFrame:
    """Class, confidence and attack flag; kept when an attack with enough confidence, severe above 0.7."""
    named = decode(named_prediction(pred), model)
    attack = ~F.col("predicted").isin("safe", "normal") & (F.col("confidence") >= threshold)
    severity = F.when(attack & (F.col("confidence") > 0.7), F.when(F.col("severity") == "critical", "critical").otherwise("high")).otherwise(F.col("severity"))
    out = named.withColumn("is_attack", attack)
    return out.withColumn("severity", severity) if "severity" in out.columns else out


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def class_report(pred: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class from the confusion counts."""
    c = confusion(pred)
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    recall = c.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    predicted = c.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("claimed"))
    p, r = F.try_divide("hits", "claimed"), F.try_divide("hits", "support")
    return recall.join(predicted, "class", "left").select(
        "class", "support", F.coalesce(p, F.lit(0.0)).alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")
    )


def evaluate(pred: DataFrame) -> DataFrame:
    """Accuracy and weighted F1 from the class report, one row."""
    report = class_report(pred)
    total, hits = F.sum("support"), F.sum(F.col("recall") * F.col("support"))
    return report.agg((hits / total).alias("accuracy"), (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"), total.alias("rows"))


# --- anomalies ------------------------------------------------------------------------------------------


def anomalies(e: DataFrame, contamination: float = 0.1, least: int = 10) -> DataFrame | None:
    """Behaviour outliers over the seven behaviour features; None below ``least`` entries."""
    rows = behaviour_features(e)
    made = isolation.fit_score(rows, BEHAVIOUR_FEATURES, "id", contamination, least=least)
    return None if made is None else made[1]


@dataclass
class Baseline:
    encoder: PipelineModel
    forest: isolation.Forest

    def score(self, e: DataFrame) -> DataFrame:
        out = self.forest.score(_unpack(self.encoder.transform(tabular_features(e))))
        return out.withColumn("anomaly_score", isolation.anomaly_score(F.col("decision")))

    def save(self, path: str) -> None:
        self.encoder.write().overwrite().save(f"{path}/encoder")
        meta = self.forest.trees.sparkSession.createDataFrame([(self.forest.features, self.forest.size, self.forest.n_trees, self.forest.threshold, bytearray(self.forest.sketch or b""))], "features ARRAY<STRING>, size INT, n_trees INT, threshold DOUBLE, sketch BINARY")
        self.forest.trees.write.mode("overwrite").parquet(f"{path}/trees")
        meta.write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> "Baseline":
        m = spark.read.parquet(f"{path}/meta").first()
        forest = isolation.Forest(list(m["features"]), spark.read.parquet(f"{path}/trees"), m["size"], m["n_trees"], m["threshold"], bytes(m["sketch"]))
        return Baseline(PipelineModel.load(f"{path}/encoder"), forest)


TEXT_TERMS = 50


def _unpack(df: DataFrame) -> DataFrame:
    v = vector_to_array("scaled")
    names = [f"x{i}" for i in range(len(TABULAR_CATEGORIES) + len(TABULAR_NUMBERS) + 4 + TEXT_TERMS)]
    return df.withColumn("_v", v).withColumns({n: F.coalesce(F.get("_v", F.lit(i)), F.lit(0.0)) for i, n in enumerate(names)})


def fit_baseline(e: DataFrame, contamination: float = 0.05, least: int = 20) -> Baseline | None:
    """Anomaly baseline on normal data: twelve tabular features and fifty terms, fitted once and saved as a whole.

    Coded categories, numbers and term counts are written; weights, scale, trees and threshold come from these.
    """
    rows = tabular_features(e)
    coded = [f"k_{c}" for c in TABULAR_CATEGORIES]
    numbers = ["f_hour", "f_weekday", *coded, *[f"n_{n}" for n in TABULAR_NUMBERS], "f_length", "f_entropy"]
    counts = [
        StringIndexer(inputCols=[f"c_{c}" for c in TABULAR_CATEGORIES], outputCols=coded, handleInvalid="keep", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="message", outputCol="words", pattern=r"\w\w+", gaps=False), CountVectorizer(inputCol="words", outputCol="terms", vocabSize=TEXT_TERMS, minDF=2.0),
    ]
    weights = [
        IDF(inputCol="terms", outputCol="tfidf"), VectorAssembler(inputCols=[*numbers, "tfidf"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
    ]
    counter = Pipeline(stages=counts).fit(rows)
    counted = cut_lineage(counter.transform(rows).select("id", *numbers, "terms"))
    scaler = Pipeline(stages=weights).fit(counted)
    encoder = PipelineModel([*counter.stages, *scaler.stages])
    n = len(TABULAR_CATEGORIES) + len(TABULAR_NUMBERS) + 4 + TEXT_TERMS
    forest = isolation.fit(_unpack(scaler.transform(counted)), [f"x{i}" for i in range(n)], "id", contamination, least=least)
    return None if forest is None else Baseline(encoder, forest)


# --- batch classifier -----------------------------------------------------------------------------------


def batch_features(e: DataFrame, keys: list[str]) -> DataFrame:
    """One row of aggregate features per batch (group of ``keys``): one aggregation, the burstiness, and the successes after the batch's first failure."""
    text = F.lower(F.coalesce("message", F.lit("")))
    has = lambda *w: text.rlike("|".join(w))
    fail = has("fail", "error", "denied", "refused")
    num = lambda k: F.coalesce(F.element_at("fields", F.lit(k)).try_cast("double"), F.lit(0.0))
    size = F.when(num("request_size") > 0, num("request_size")).otherwise(F.length(F.coalesce("message", F.lit(""))).cast("double"))
    odd = F.coalesce("message", F.lit("")).rlike("|".join(f"(?:{p})" for p in attacks.SUSPICIOUS))
    g = e.groupBy(*keys).agg(
        F.count("*").alias("eventCount"), F.sum(size).alias("sbytes"), F.sum(num("response_size")).alias("dbytes"), F.count_if(fail).alias("_fail"),
        F.count_if(fail & has("invalid", "unknown")).alias("_invalid"), F.count_if(has("error", "failed")).alias("_error"), F.count_if(has("mfa", "2fa")).alias("_mfa"),
        F.count_if(odd).alias("suspiciousPatternCount"), F.count_if(off_hours(F.col("ts"))).alias("_off"), F.countDistinct("source.ip").alias("uniqueSourceIps"),
        F.countDistinct("user.name").alias("uniqueTargetUsers"), F.countDistinct("destination.hostname").alias("uniqueTargetHosts"), F.countDistinct("source.port").alias("uniquePorts"),
        F.count_if(F.coalesce(F.array_contains("tags", "privilege_escalation") | F.col("action").isin("sudo", "su"), F.lit(False))).alias("_privileged"),
        ((F.max(micros()) - F.min(micros())) / MINUTE).alias("_span"),
    )
    b = burstiness(e, keys).drop("events")
    timed = e.where("ts IS NOT NULL AND outcome IN ('failure', 'success')").select(*keys, "outcome", micros().alias("us"))
    first = timed.where("outcome = 'failure'").groupBy(*keys).agg(F.min("us").alias("first"))
    after = timed.where("outcome = 'success'").join(first, keys).where("us > first").groupBy(*keys).agg(F.count("*").alias("_after"))
    g = g.join(after, keys, "left")
    n, span = F.col("eventCount"), F.col("_span")
    return g.join(b, keys).withColumns({
        "failureRate": F.col("_fail") / n, "invalidUserRatio": F.coalesce(F.try_divide("_invalid", "_fail"), F.lit(0.0)), "errorCodeRatio": F.col("_error") / n,
        "mfaFailureRate": F.col("_mfa") / n, "offHoursActivity": F.col("_off") / n, "smeansz": F.col("sbytes") / n, "dmeansz": F.col("dbytes") / n, "res_bdy_len": F.col("sbytes") * 0.1,
        "eventsPerMinute": F.when(span > 0, n / span).otherwise(n.cast("double")), "actionVelocity": n / F.greatest(span / 60, F.lit(1.0)),
        "targetUserEntropy": F.log2(F.greatest("uniqueTargetUsers", F.lit(1)).cast("double")),
        "sourceIpEntropy": F.log2(F.greatest("uniqueSourceIps", F.lit(1)).cast("double")), "privilegedUserRatio": F.col("_privileged") / n, "successAfterFailure": F.coalesce("_after", F.lit(0)),
        "ct_srv_src": F.least(F.col("uniqueSourceIps") * 0.5, F.lit(100.0)), "ct_srv_dst": F.least(F.col("uniqueTargetHosts") * 0.5, F.lit(100.0)),
        "ct_src_dport_ltm": F.least(F.col("uniquePorts").cast("double"), F.lit(100.0)), "ct_dst_src_ltm": F.least(F.col("uniqueSourceIps") * F.col("uniqueTargetHosts") / 10, F.lit(100.0)),
    }).drop("_fail", "_invalid", "_error", "_mfa", "_off", "_span", "_privileged", "_after")


def false_positive(attack_type: Column) -> Column:
    """Why a reported type is a false positive; null when it is not."""
    c = F.col
    return (
        F.when(c("eventCount") < 10, "insufficient events").when((attack_type == "bruteforce") & (c("failureRate") < 0.7), "success rate too high")
        .when((attack_type == "password_spray") & (c("uniqueTargetUsers") < 10), "too few users").when((attack_type == "dos") & (c("eventsPerMinute") < 50), "event rate too low")
        .when((attack_type == "port_scan") & (c("uniquePorts") < 10), "too few ports").when((attack_type == "sql_injection") & (c("errorCodeRatio") < 0.15), "low error rate")
        .when((attack_type == "xss_attack") & (c("errorCodeRatio") < 0.1), "low error rate").when((attack_type == "log4shell") & (c("suspiciousPatternCount") < 3), "too few patterns")
        .when((attack_type == "ransomware") & (c("actionVelocity") < 20), "action velocity too low")
        .when((c("failureRate") == 0) & (c("errorCodeRatio") == 0) & (c("suspiciousPatternCount") < 2), "no errors or patterns")
    )


def classify_batch(e: DataFrame, keys: list[str], thresholds: dict[str, float] = ATTACK_THRESHOLDS) -> DataFrame:
    """Attack types of each batch: weighted mean of scaled features against the type's threshold."""
    f = batch_features(e, keys)
    unit = {n: clip_unit(F.col(n).cast("double"), *FEATURE_RANGES[n]) for n in FEATURE_RANGES}
    options = []
    for name, weights in ATTACK_WEIGHTS.items():
        parts = {k: (unit[k] * w if w > 0 else (1 - unit[k]) * -w) for k, w in weights.items()}
        total = sum(abs(w) for w in weights.values())
        value = sum(list(parts.values())[1:], list(parts.values())[0]) / total
        top = F.slice(F.reverse(F.array_sort(F.array(*[F.struct(F.round(v, 6).alias("c"), F.lit(k).alias("f")) for k, v in parts.items()]))), 1, 3)
        options.append(F.struct(F.lit(name).alias("attack_type"), value.alias("score"), F.lit(thresholds[name]).alias("threshold"), F.transform(top, lambda t: t["f"]).alias("top_features")))
    long = f.withColumn("_o", F.explode(F.array(*options))).where("_o.score >= _o.threshold")
    named = long.withColumns({"attack_type": F.col("_o.attack_type"), "score": F.col("_o.score"), "top_features": F.col("_o.top_features")}).drop("_o")
    return named.withColumns({
        "confidence": F.least(F.col("score") * 1.2, F.lit(0.95)), "probability": sigmoid(F.col("score") * 5 - 2.5), "false_positive_reason": false_positive(F.col("attack_type")),
    }).withColumn("is_false_positive", F.col("false_positive_reason").isNotNull())


PROFILE_FEATURES = ["failure_rate", "events", "sources", "users"]


def window_features(e: DataFrame, minutes: int = 60) -> DataFrame:
    """Window features per log type behind the baseline profiles."""
    return e.groupBy("log_type", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.count("*").alias("events"), F.avg(F.when(F.col("outcome") == "failure", 1.0).otherwise(0.0)).alias("failure_rate"),
        F.countDistinct("source.ip").alias("sources"), F.countDistinct("user.name").alias("users"),
    )


def profile(e: DataFrame, minutes: int = 60) -> DataFrame:
    """Mean, deviation, least and greatest value of each window feature per log type."""
    rows = window_features(e, minutes).select("log_type", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in PROFILE_FEATURES])).alias("f"))
    v = F.col("f.value")
    return rows.groupBy("log_type", F.col("f.feature").alias("feature")).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def score_profile(e: DataFrame, p: DataFrame, minutes: int = 60, limit: float = 3.0) -> DataFrame:
    """Windows against the profile: deviating features, their summed score and the capped risk."""
    rows = window_features(e, minutes).select("log_type", F.unix_micros(F.col("w.start")).alias("start_us"), F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in PROFILE_FEATURES])))
    z = F.abs(F.try_divide(F.col("value") - F.col("mean"), F.col("std")))
    j = rows.join(p, ["log_type", "feature"]).withColumn("z", F.coalesce(z, F.lit(0.0))).where(F.col("z") > limit)
    return j.groupBy("log_type", "start_us").agg(F.count("*").alias("deviating"), F.sum("z").alias("score")).withColumn("risk", F.least(F.col("score") * 20, F.lit(100.0)))


# --- feedback and versions ------------------------------------------------------------------------------


def feedback_labels(fb: DataFrame) -> DataFrame:
    """Training rows from feedback: a safe attack becomes normal, an unsafe normal its corrected type."""
    safe = (F.col("user_label") == "safe") & (F.col("original_prediction") != "normal")
    missed = (F.col("user_label") == "unsafe") & (F.col("original_prediction") == "normal")
    label = F.when(safe, "normal").when(missed, F.coalesce(F.element_at("feedback_metadata", F.lit("corrected_attack_type")), F.lit("unknown")))
    return fb.withColumn("attack_type", label).where("attack_type IS NOT NULL").select(
        F.col("entry_id").alias("id"), F.col("log_message").alias("message"), "source_ip", "log_type", "attack_type",
        F.when(F.col("attack_type") == "normal", "info").otherwise("warning").alias("severity"), F.when(F.col("attack_type") == "normal", "success").otherwise("failure").alias("outcome"),
    )


def retraining_set(base: DataFrame, fb: DataFrame, least: int = 10) -> DataFrame:
    """Base rows with the feedback rows, once there are ``least`` of them."""
    rows = feedback_labels(fb)
    enough = rows.agg(F.count("*").alias("n")).scalar() >= least
    return base.unionByName(rows.where(enough), allowMissingColumns=True)


def privatize_ips(df: DataFrame, eps: float, seed: int, col: str = "source_ip", id_col: str = "id") -> DataFrame:
    """With probability 1/(1+eps) the last octet becomes a random one; drawn per row from its id, so retries agree."""
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    octet = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(254)) + 1).cast("string")
    noisy = F.concat(F.substring_index(F.col(col), ".", 3), F.lit("."), octet)
    return df.withColumn(col, F.when((draw < 1.0 / (1.0 + eps)) & F.col(col).rlike(r"^\d+\.\d+\.\d+\.\d+$"), noisy).otherwise(F.col(col)))


VERSION_DDL = "version_id STRING, timestamp TIMESTAMP, training_samples BIGINT, accuracy DOUBLE, f1_score DOUBLE, changes STRING, feedback_count BIGINT, is_active BOOLEAN"


def register(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Version table with a new, active version."""
    return versions.withColumn("is_active", F.lit(False)).unionByName(new.withColumn("is_active", F.lit(True)))


def rollback(versions: DataFrame, version_id: str) -> DataFrame:
    """The given version active; nothing changes when it is unknown."""
    known = versions.agg(F.coalesce(F.bool_or(F.col("version_id") == version_id), F.lit(False)).alias("k")).scalar()
    return versions.withColumn("is_active", F.when(known, F.col("version_id") == version_id).otherwise(F.col("is_active")))


def compare(versions: DataFrame, a: str, b: str) -> DataFrame:
    """Differences of two versions, second minus first; no row when one is unknown."""
    pick = lambda v, col: F.max(F.when(F.col("version_id") == v, F.col(col)))
    return versions.agg(
        (pick(b, "accuracy") - pick(a, "accuracy")).alias("accuracy_diff"), (pick(b, "feedback_count") - pick(a, "feedback_count")).alias("feedback_diff")
    ).where("accuracy_diff IS NOT NULL")


def save_version(model: Transformer, path: str, version_id: str) -> str:
    target = f"{path}/{version_id}"
    model.write().overwrite().save(target)
    return target
