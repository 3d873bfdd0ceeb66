"""Isolation forest (Liu, Ting and Zhou, 2008): trees from a small Spark sample, scores in Spark tasks.

A tree sees at most ``size`` sampled rows, so trees are built in one grouped task each and the whole forest
has at most trees * 2 * size nodes, which is the proven bound of what is shipped to the scoring tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.session import cut_lineage

TREE_DDL = "tree INT, node INT, feature INT, cut DOUBLE, low INT, high INT, size INT"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    c = 2.0 * (np.log(np.maximum(safe - 1.0, 1.0)) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([at, -1, 0.0, -1, -1, len(rows)])
        spread = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(usable) == 0:
            return at
        f = int(rng.choice(usable))
        lo = x[rows, f].min()
        cut = float(lo + rng.random() * spread[f])
        left = x[rows, f] < cut
        if not left.any():
            left = x[rows, f] <= lo
        nodes[at][1:5] = [f, cut, add(rows[left], depth + 1), add(rows[~left], depth + 1)]
        return at

    add(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


@dataclass(frozen=True)
class Forest:
    features: list[str]
    trees: DataFrame
    size: int
    n_trees: int
    threshold: float
    #: Quantile sketch of the scores of the rows it was fitted on; others merge with it or ask it for another share.
    sketch: bytes | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``raw_score`` (higher is stranger), ``decision`` (below 0 is an anomaly) and ``is_anomaly``."""
        return score(df, self)


#: Size of the quantile sketch: the rank of a quantile is off by some 0.1 % of the rows.
SKETCH = 4096


def cut_off(scored: DataFrame, contamination: float) -> tuple[float, bytes]:
    """The score that a share of the rows lies above, from a mergeable sketch of all scores, and the sketch."""
    made = scored.agg(F.kll_sketch_agg_double("raw_score", F.lit(SKETCH)).alias("s"))
    row = made.select("s", F.kll_sketch_get_quantile_double("s", F.lit(1.0 - contamination)).alias("q")).first()
    return float(row["q"]), bytes(row["s"])


def fit_score(df: DataFrame, features: list[str], id_col: str, contamination: float, **options) -> tuple[Forest, DataFrame] | None:
    """A forest and the same rows with their scores, which are computed once and written; None below ``least`` rows."""
    forest = grow(df, features, id_col, **options)
    if forest is None:
        return None
    scored = cut_lineage(raw_scores(df, forest))
    threshold, sketch = cut_off(scored, contamination)
    fitted = replace(forest, threshold=threshold, sketch=sketch)
    return fitted, flagged(scored, fitted)


def fit(df: DataFrame, features: list[str], id_col: str, contamination: float, **options) -> Forest | None:
    """Forest over the feature columns, its threshold from the scores of these rows; None below ``least`` rows."""
    forest = grow(df, features, id_col, **options)
    if forest is None:
        return None
    threshold, sketch = cut_off(raw_scores(df, forest).select("raw_score"), contamination)
    return replace(forest, threshold=threshold, sketch=sketch)


def grow(df: DataFrame, features: list[str], id_col: str, n_trees: int = 100, size: int = 256, seed: int = 42, least: int = 10) -> Forest | None:
    """Forest without a threshold; None below ``least`` rows.

    Rows are sampled by a hash of their id, so the same data gives the same trees in any partitioning.
    """
    rows = df.select(id_col, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    total = rows.count()
    if total < least:
        return None
    want = n_trees * size
    # One rule for any number of rows: a row is drawn 1.5 * want / total times on average, each time for a tree of its hash.
    draws = 1.5 * want / total
    hashed = rows.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed)))
    unit = F.xxhash64("_h", F.lit(seed + 1)) / F.lit(2.0**64) + 0.5
    times = F.lit(int(draws)) + (unit < draws - int(draws)).cast("int")
    drawn = hashed.withColumn("_times", times).where("_times > 0").withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    placed = drawn.withColumn("tree", F.pmod(F.xxhash64("_h", "_draw"), F.lit(n_trees)).cast("int")).drop("_draw", "_times").dropDuplicates([id_col, "_h", "tree"])
    limit = int(np.ceil(np.log2(max(size, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        part = pdf.sort_values(["_h", id_col]).head(size)
        rng = np.random.default_rng([seed, tree])
        nodes = _grow(part[features].to_numpy(float), limit, rng)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "cut", "low", "high", "size"])

    trees = placed.groupBy("tree").applyInPandas(build, TREE_DDL)
    # bounded by trees * 2 * size rows; kept as plain rows so that scoring and saving use the same forest
    frozen = df.sparkSession.createDataFrame(trees.toPandas(), TREE_DDL)
    return Forest(features, frozen, min(size, total), n_trees, 0.0)


def score(df: DataFrame, forest: Forest) -> DataFrame:
    return flagged(raw_scores(df, forest), forest)


def flagged(scored: DataFrame, forest: Forest) -> DataFrame:
    return scored.withColumn("decision", F.lit(forest.threshold) - F.col("raw_score")).withColumn("is_anomaly", F.col("decision") < 0)


def raw_scores(df: DataFrame, forest: Forest) -> DataFrame:
    """Scores by walking each batch of rows through all trees at once."""
    nodes = forest.trees.toPandas()
    arrays = []
    for _, t in nodes.groupby("tree", sort=True):
        t = t.sort_values("node")
        feature, node, low, high = (t[c].to_numpy() for c in ("feature", "node", "low", "high"))
        # A leaf leads to itself, so all rows take the same number of steps; nodes come behind their parents.
        leaf, depth = feature < 0, np.zeros(len(t), dtype=int)
        for i in np.flatnonzero(~leaf):
            depth[[low[i], high[i]]] = depth[i] + 1
        arrays.append((np.where(leaf, 0, feature), np.where(leaf, np.inf, t["cut"].to_numpy()), np.where(leaf, node, low), np.where(leaf, node, high), depth + average_path(t["size"].to_numpy()), int(depth.max())))
    norm, features = float(average_path(float(forest.size))) or 1.0, forest.features
    shipped = df.sparkSession.sparkContext.broadcast(arrays)

    def walk(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([np.nan_to_num(c.to_numpy(float)) for c in cols])
        total, flat, start = np.zeros(len(x)), x.ravel(), np.arange(len(x)) * x.shape[1]
        for feature, cut, low, high, length, steps in shipped.value:
            at = np.zeros(len(x), dtype=int)
            for _ in range(steps):
                at = np.where(flat[start + feature[at]] < cut[at], low[at], high[at])
            total += length[at]
        return pd.Series(np.power(2.0, -total / len(shipped.value) / norm))

    run = F.pandas_udf(walk, "double")
    return df.withColumn("raw_score", run(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))


def anomaly_score(decision: Column) -> Column:
    """Decision value brought to 0..1, higher is stranger."""
    return (1 - decision) / 2
