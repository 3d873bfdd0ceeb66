"""Whole jobs: from lines to alerts and statistics, and from entries to chains.

Entries are written once to the checkpoint folder before they fan out, so the long field-extraction plan is
neither planned nor run again for each alert rule and statistic. Lines are dealt evenly over the tasks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tracehound.operators import correlate, detect, parsing, stats
from tracehound.session import cut_lineage


def parse_lines(
    lines: DataFrame, default_year: int, force_type: str | None = None, per_source: bool = False,
    ingest: Column | None = None, geo: DataFrame | None = None,
) -> DataFrame:
    """Lines to entries, with the country when a range table is given."""
    entries = parsing.to_entries(parsing.parse(lines, default_year, force_type, per_source, ingest))
    if geo is not None:
        from pyspark.sql import functions as F

        entries = parsing.enrich_country(entries.drop("country").withColumn("_src", F.col("source.ip")), geo, "_src").drop("_src")
    return entries


def deal(lines: DataFrame) -> DataFrame:
    """The lines in even parts over all tasks: parsing a line costs far more than moving it, and a file may give few tasks."""
    spark = lines.sparkSession
    return lines.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def parse_job(lines: DataFrame, default_year: int, cfg: detect.DetectionConfig = detect.DetectionConfig(), **how) -> dict[str, DataFrame]:
    """Entries with keyword tags, alerts with anomaly alerts, and the statistics of one upload."""
    entries = cut_lineage(detect.tag_keywords(parse_lines(deal(lines), default_year, **how)))
    alerts = detect.run_detections(entries, cfg)
    return {
        "entries": entries, "alerts": alerts, "anomaly_alerts": detect.anomaly_alerts(entries, alerts),
        "counts": stats.count_by(entries), "top_sources": stats.top_sources(entries), "top_users": stats.top_users(entries),
        "timeline": stats.minute_timeline(entries), "summary": stats.attack_summary(entries),
    }


def correlate_job(lines: DataFrame, default_year: int, **how) -> dict[str, DataFrame]:
    """Chains, timeline, summary and advice over named sources."""
    entries = cut_lineage(parse_lines(lines, default_year, **how))
    return {"entries": entries, **correlate.correlate(entries)}
