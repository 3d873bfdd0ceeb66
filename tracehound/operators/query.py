"""Filters, projections, sorts and set operations on entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.schema import is_attack, union_all


def search(e: DataFrame, text: str = "", choice: str = "all") -> DataFrame:
    """Free text in message, user or IP, and a choice that is an attack type of the data or a severity.

    A choice counts as an attack type when any entry carries it; the test is a scalar subquery, so it stays
    in the same job.
    """
    out = e
    if text:
        low = text.lower()
        out = out.where(
            F.contains(F.lower("message"), F.lit(low))
            | F.coalesce(F.contains(F.col("source.ip"), F.lit(text)), F.lit(False))
            | F.coalesce(F.contains(F.lower("user.name"), F.lit(low)), F.lit(False))
        )
    if choice != "all":
        known = e.agg(F.coalesce(F.bool_or(F.col("attack_type") == choice), F.lit(False)).alias("k")).scalar()
        out = out.where(F.when(known, F.col("attack_type") == choice).otherwise(F.col("severity") == choice))
    return out


def _criterion(c: dict) -> Column:
    if c.get("attack_type"):
        if c["attack_type"] == "any":
            return F.col("attack_type").isNotNull() & (F.col("attack_type") != "normal")
        return F.col("attack_type") == c["attack_type"]
    if c.get("severity"):
        return F.col("severity") == c["severity"]
    if c.get("log_type"):
        return F.contains(F.lower("log_type"), F.lit(c["log_type"].lower()))
    if c.get("column") and c.get("value") is not None:
        path, value = c["column"], c["value"]
        col = F.element_at(F.col("fields"), F.lit(path[7:])) if path.startswith("fields.") else F.col(path)
        op = c.get("operator", "equals")
        if op in ("greaterThan", "lessThan"):
            # plain numbers are compared without a cast on the column, so the test can reach the scan
            number = float(value)
            typed = col if c.get("numeric") else col.cast("string").try_cast("double")
            return typed > number if op == "greaterThan" else typed < number
        low, text = F.lower(col.cast("string")), F.lit(str(value).lower())
        return {
            "contains": F.contains(low, text), "startsWith": F.startswith(low, text), "endsWith": F.endswith(low, text),
        }.get(op, low == text)
    return F.lit(True)


def filter_criteria(e: DataFrame, criteria: list[dict]) -> DataFrame:
    """All criteria at once: attack type, severity, log type, or a column with an operator and a value."""
    for c in criteria:
        e = e.where(_criterion(c))
    return e


def query_entries(e: DataFrame, criteria: list[dict], n: int) -> DataFrame:
    """Filtered entries, newest first, at most ``n``."""
    return filter_criteria(e, criteria).orderBy(F.col("ts").desc_nulls_last(), "id").limit(n)


def query_counts(e: DataFrame, criteria: list[dict]) -> DataFrame:
    """Total and filtered number of entries, in one pass."""
    cond = F.lit(True)
    for c in criteria:
        cond = cond & F.coalesce(_criterion(c), F.lit(False))
    return e.agg(F.count("*").alias("total_count"), F.count_if(cond).alias("filtered_count"))


def select_view(
    views: dict[str, DataFrame], name: str, severity: str | None = None, log_type: str | None = None,
    attack_type: str | None = None, limit: int | None = None,
) -> DataFrame:
    """One of the prepared views (entries, alerts, predictions, statistics) with the usual filters."""
    if name not in views:
        raise KeyError(f"unknown view {name!r}, have {sorted(views)}")
    df = views[name]
    for col, value in (("severity", severity), ("log_type", log_type), ("attack_type", attack_type)):
        if value is not None and col in df.columns:
            df = df.where(F.col(col) == value)
    return df if limit is None else df.limit(limit)


def field_names(e: DataFrame) -> DataFrame:
    """Distinct keys of the open fields that hold a value anywhere in the data."""
    return (
        e.select(F.explode("fields").alias("key", "value"))
        .where("value IS NOT NULL AND value <> '' AND key <> '_detected_fields'")
        .select("key").distinct()
    )


def field_cells(e: DataFrame) -> DataFrame:
    """Open fields in long form, (id, key, value); fits any number of keys."""
    return e.select("id", F.explode("fields").alias("key", "value")).where("value IS NOT NULL AND value <> ''")


def flatten_fields(e: DataFrame, names: list[str]) -> DataFrame:
    """Open fields of the given names as flat columns ``fields_<key>``.

    Keys become column names, so the caller names them (``field_names`` lists those of the data); ``field_cells``
    is the form that needs no names and holds any number of keys.
    """
    return e.select("*", *[F.coalesce(F.nullif(F.element_at("fields", F.lit(k)), F.lit("")), F.lit("-")).alias(f"fields_{k}") for k in names])


def attacks_only(e: DataFrame) -> DataFrame:
    return e.where(is_attack())


def recent_feedback(fb: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return fb.where(F.col("timestamp") > now - F.make_dt_interval(hours=F.lit(hours)))


def sort_by(e: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """Sorted by any column as text, ties by id."""
    key = F.lower(F.coalesce(F.col(col).cast("string"), F.lit("")))
    return e.orderBy(key.desc() if descending else key.asc(), "id")


def most_recent(df: DataFrame, n: int, by: str = "ts", tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), tie).limit(n)


def rank_findings(f: DataFrame, by: str = "score", tie: str = "filename") -> DataFrame:
    return f.orderBy(F.col(by).desc_nulls_last(), tie)


def first_per_group(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """First ``k`` rows of each group; Spark drops the rest of a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def union_frames(*frames: DataFrame) -> DataFrame:
    return union_all(list(frames))


def dedupe(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropDuplicates(cols)


def set_overlap(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: how many values both sides share, and how many each side has alone."""
    left = a.select(*keys, value).distinct().withColumn("l", F.lit(1))
    right = b.select(*keys, value).distinct().withColumn("r", F.lit(1))
    both = left.join(right, [*keys, value], "full")
    return both.groupBy(*keys).agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"),
        F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"),
    )
