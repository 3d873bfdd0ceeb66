"""Writers: entry export, finding export, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ["safe", "unsafe", "attack_pattern"]


def export_frame(e: DataFrame, ids: DataFrame, fmt: str) -> DataFrame:
    """Selected entries in the shape of the format: nine CSV columns, whole rows for JSON, raw lines for text."""
    chosen = e.join(ids.select("id").distinct(), "id", "left_semi")
    if fmt == "csv":
        return chosen.select(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "log_type", "severity", F.coalesce(F.col("source.ip"), F.lit("")).alias("source_ip"),
            F.coalesce(F.col("user.name"), F.lit("")).alias("user"), F.coalesce("action", F.lit("")).alias("action"),
            F.coalesce("outcome", F.lit("")).alias("outcome"), F.coalesce("message", F.lit("")).alias("message"),
            F.coalesce("attack_type", F.lit("normal")).alias("attack_type"),
        )
    if fmt == "json":
        return chosen
    if fmt == "text":
        return chosen.select(F.coalesce(F.nullif(F.col("raw_line"), F.lit("")), F.col("message")).alias("value"))
    raise ValueError(f"unknown format {fmt!r}")


def export_entries(e: DataFrame, ids: DataFrame, fmt: str, path: str) -> None:
    writer = export_frame(e, ids, fmt).write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True, quoteAll=False, escape='"')
    else:
        writer.format(fmt).save(path)


def export_finding_frame(f: DataFrame) -> DataFrame:
    """One row per indicator of a finding; time differences in days."""
    days = F.round(F.col("i.time_diff_seconds") / 86400, 2)
    return f.select("filename", "severity", "score", F.explode("indicators").alias("i")).select(
        F.col("filename").alias("Filename"), F.col("severity").alias("Severity"), F.col("score").alias("Score"), F.col("i.rule_id").alias("Rule ID"),
        F.col("i.description").alias("Description"), F.col("i.timestamp_value").alias("Timestamp Value"), F.col("i.expected_value").alias("Expected Value"),
        F.when(F.coalesce(F.col("i.time_diff_seconds"), F.lit(0)) != 0, days).alias("Time Diff (Days)"), F.col("i.source_layer").alias("Source Layer"),
    )


def export_findings(f: DataFrame, path: str) -> None:
    export_finding_frame(f).write.mode("overwrite").csv(path, header=True)


def valid_feedback(fb: DataFrame) -> DataFrame:
    """Feedback that may be stored: known label, entry and prediction given."""
    return fb.where(F.col("user_label").isin(LABELS) & F.col("entry_id").isNotNull() & F.col("original_prediction").isNotNull())


def append_feedback(fb: DataFrame, path: str) -> None:
    valid_feedback(fb).write.mode("append").parquet(path)


def bulk_feedback(entries: DataFrame, user_id: str, label: str, now: Column, corrected_type: str | None = None) -> DataFrame:
    """The same label for many entries; a corrected type goes into the metadata."""
    meta = {"bulk": "true", **({"corrected_attack_type": corrected_type} if corrected_type else {})}
    return valid_feedback(entries.select(
        F.col("id").alias("entry_id"), F.lit(user_id).alias("user_id"), now.alias("timestamp"),
        F.coalesce("attack_type", F.lit("normal")).alias("original_prediction"), F.lit(label).alias("user_label"),
        F.coalesce("attack_confidence", F.lit(0.0)).alias("confidence"), F.col("message").alias("log_message"), F.col("source.ip").alias("source_ip"), "log_type",
        F.array().cast("array<string>").alias("mitre_tactics"), F.array().cast("array<string>").alias("mitre_techniques"),
        F.create_map(*[F.lit(x) for kv in meta.items() for x in kv]).alias("feedback_metadata"),
    ))
