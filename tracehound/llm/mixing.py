"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.llm.common import seeded, shared_folder, table, total, word_count, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
BUCKETS = 4096
#: Rows of the table of sources up to which it is broadcast; beyond it, sources join by shuffle.
BROADCAST_SOURCES = 20_000


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size): shares of the whole size by weight, none above max_epochs times its size.

    Weights go to sources by code point, null last, and repeat. In order of cap by weight, a source is full if the
    level that the rest would have reaches its cap; the first that is not full has the final level, the highest of
    those that reach no cap. A row per source passes one window, never a row per document. Without rows the result is empty; with no words all targets are 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", (max_epochs * F.col("source_size")).cast("long"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("_rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("_level", F.col("_rest") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("_final", F.max(F.when(F.col("cap") >= F.col("_level") * F.col("weight"), F.col("_level"))).over(everything))
    level = F.coalesce(F.col("_final"), F.lit(float("inf")))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    keep: Column | None = None,
) -> DataFrame:
    """How often the mix takes each row: doc (the row, or `keep` of it), size, source_size, target, repeats, taken.

    A source at e epochs takes each row floor(e) times, and once more the rows with the smallest seeded hashes until
    their words come to the rest. The hash range is cut into buckets; sums by source and bucket find the bucket in
    which the rest ends, and only the rows of that bucket are ordered, so a hot source is never sorted.

    Null text has size 0 and is never taken in words (its whole repeats stay). Null source is a source of its own.
    Rows with the same id and text share a fate, others do not: the hash is of id and text, so rows without an id are
    dealt like any. Other columns pass through in `doc` whatever their names. An empty table gives none.
    """
    folder = shared_folder(docs.sparkSession)
    doc = F.struct(*[docs[f"`{c}`"] for c in docs.columns]) if keep is None else keep
    rows = docs.select(doc.alias("doc"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), seeded(seed, docs[id_col], F.md5(docs[text_col])).alias("hash"))
    rows = rows.withColumn("bucket", (F.shiftright("hash", 48)).cast("int"))  # 60 bits: 4096 buckets
    cells = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), folder, "cells")
    plan = water_fill(cells.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")), weights, max_epochs)
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = written(plan.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), folder, "plan")
    few = total(plan, F.count("*"))[0] <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda df: df

    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = cells.withColumn("filled", F.coalesce(F.sum("words").over(in_order), F.lit(0)))
    cut = filled.join(small(plan.select(F.col("source").alias("_s"), "rest")), F.col("source").eqNullSafe(F.col("_s"))).where(F.col("filled") < F.col("rest"))
    cut = written(cut.groupBy("source").agg(F.max("bucket").alias("cut"), F.max("filled").alias("filled"), F.max("rest").alias("rest")), folder, "cut")
    near = rows.select("source", "size", "hash", "bucket").join(small(cut.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("cut")))
    upto = Window.partitionBy("source").orderBy("hash").rangeBetween(Window.unboundedPreceding, 0)
    at_hash = Window.partitionBy("source", "hash")
    near = near.withColumn("_end", F.col("filled") + F.sum("size").over(upto)).withColumn("_own", F.sum("size").over(at_hash))
    last = near.where(F.col("_end") - F.col("_own") / 2 <= F.col("rest")).groupBy("source").agg(F.max("hash").alias("_last"))
    below = F.shiftleft(F.col("cut").cast("long"), 48) - 1
    ends = cut.select("source", below.alias("_below")).join(small(last.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left")
    ends = written(ends.select("source", F.greatest("_below", "_last").alias("upto")), folder, "ends")
    plan = plan.join(small(ends.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    out = rows.join(small(plan.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
    repeats = F.col("whole") + F.when(F.col("hash") <= F.col("upto"), 1).otherwise(0)
    return out.select("doc", "size", "source_size", "target", repeats.cast("long").alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it."""
    out = mix(docs, **options).where(F.col("repeats") > 0)
    return out.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mix(docs, keep=docs["doc_id"])
    return out.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 15) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS cap,
             (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s),
g AS (SELECT *, max(CASE WHEN cap >= level * weight THEN level END) OVER () AS final FROM f),
p AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap::DOUBLE, final * weight) END AS target FROM g),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM p),
r AS (SELECT d.doc_id, d.size, d.hash, q.*, q.target - q.whole * q.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.hash) AS own FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN rest > 0 AND upto - own / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
