"""Schemas and small helpers on the entry table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY_DDL = """
    id STRING, source_name STRING, line_no BIGINT, ts TIMESTAMP, log_type STRING, category STRING,
    log_source STRING, severity STRING,
    source STRUCT<ip: STRING, port: INT, hostname: STRING, service: STRING, pid: INT>,
    destination STRUCT<ip: STRING, port: INT, hostname: STRING>,
    user STRUCT<name: STRING, domain: STRING>, action STRING, outcome STRING, country STRING,
    message STRING, raw_line STRING, fields MAP<STRING, STRING>, tags ARRAY<STRING>,
    attack_type STRING, attack_confidence DOUBLE, mitre_tactics ARRAY<STRING>, mitre_techniques ARRAY<STRING>,
    is_anomaly BOOLEAN, anomaly_score DOUBLE
"""

FEEDBACK_DDL = """
    entry_id STRING, user_id STRING, timestamp TIMESTAMP, original_prediction STRING, user_label STRING,
    confidence DOUBLE, log_message STRING, source_ip STRING, log_type STRING, mitre_tactics ARRAY<STRING>,
    mitre_techniques ARRAY<STRING>, feedback_metadata MAP<STRING, STRING>
"""

SECOND = 1_000_000
MINUTE = 60 * SECOND


def src_ip() -> Column:
    return F.col("source.ip")


def user_name() -> Column:
    return F.col("user.name")


def micros(col: Column | str = "ts") -> Column:
    """Event time as whole microseconds, the unit of all interval arithmetic."""
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def from_micros(col: Column) -> Column:
    return F.timestamp_micros(col)


def is_attack() -> Column:
    return F.coalesce(~F.col("attack_type").isin("safe", "normal"), F.lit(False))


def is_auth_event() -> Column:
    return (
        F.array_contains("tags", "auth") | F.array_contains("tags", "ssh") | (F.col("log_type") == "ssh_auth")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; missing columns become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """Columns that are evaluated once per row, whatever is done with them later.

    A plain projection of an expensive expression is repeated in every filter that Catalyst pushes below it;
    a generator over one element keeps it in one place.
    """
    made = df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(f"_new_{n}") for n, c in cols.items()]))))
    return made.drop(*cols).withColumnsRenamed({f"_new_{n}": n for n in cols})
