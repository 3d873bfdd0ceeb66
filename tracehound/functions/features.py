"""Feature columns for the classifiers and the anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions import prefilter as pre
from tracehound.functions.normalize import field
from tracehound.functions.scalars import entropy
from tracehound.rules import attacks, dims
from tracehound.schema import computed

ATTACK_FEATURES = [
    "is_external_ip", "message_length", "sql_hits", "xss_hits", "command_hits", "traversal_hits", "inclusion_hits",
    "is_http", "has_failure", "severity_level", "is_anonymous", "has_url_encoding", "has_ip", "has_port",
    "system_path_hits", "sensitive_words", "is_login", "has_angle_brackets", "has_single_quote",
    "has_equals_quote", "has_double_dash", "has_semicolon", "has_pipe", "has_backtick", "is_connection",
]
BEHAVIOUR_FEATURES = ["ip_hash", "user_hash", "length", "severity_code", "n_fields", "hour", "weekday"]
TABULAR_NUMBERS = ["status", "bytes", "port", "src_port", "dst_port", "duration_ms"]
TABULAR_CATEGORIES = ["log_type", "severity", "action", "outcome"]


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def attack_features(e: DataFrame) -> DataFrame:
    """The 25 attack features of an entry, each 0..1, beside the entry's own columns."""
    text = F.lower(F.coalesce(F.nullif(F.col("raw_line"), F.lit("")), F.col("message"), F.lit("")))
    src = F.coalesce(F.col("source.ip"), F.lit(""))
    user = F.coalesce(F.col("user.name"), F.lit(""))
    internal = src.rlike(r"^(192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[01]))")
    counts = [f"'{name}', least(({pre.count(pattern, pre.TEXT, pre.TEXT)}) / 3.0D, 1.0D)" for name, pattern in attacks.FEATURE_COUNTS]
    flags = [f"'{name}', double({pre.matches(pattern, pre.TEXT, pre.TEXT)})" for name, pattern in attacks.FEATURE_FLAGS]
    words = " + ".join(f"int(contains({pre.TEXT}, {pre.quoted(w)}))" for w in attacks.SENSITIVE_WORDS)
    login = " OR ".join(f"contains({pre.TEXT}, '{w}')" for w in ("auth", "password"))
    more = [f"'sensitive_words', least(({words}) / 3.0D, 1.0D)", f"'is_login', double({login})", f"'message_length', least(length({pre.TEXT}) / 500.0D, 1.0D)"]
    bound, found = pre.decided(e, text, f"named_struct({', '.join(counts + flags + more)})")
    cols = {
        "is_external_ip": _flag(~internal),
        "has_failure": _flag((F.col("outcome") == "failure") | F.col("outcome").rlike(r"^(4|5)\d{2}$")),
        "severity_level": _flag(F.col("severity").isin("warning", "error", "critical")),
        "is_anonymous": _flag(user.isin("", "anonymous", "www-data", "nobody", "root")),
        "is_login": F.greatest(_flag(F.contains(F.lower(F.coalesce("action", F.lit(""))), F.lit("login"))), F.col("_found.is_login")),
    }
    made = computed(bound, _found=found).withColumns({name: cols[name] if name in cols else F.col(f"_found.{name}") for name in ATTACK_FEATURES})
    return made.drop("_found", "_t")


def severity_code(col: Column) -> Column:
    out = None
    for name, code in dims.SEVERITY_CODE.items():
        out = F.when(col == name, code) if out is None else out.when(col == name, code)
    return out.otherwise(1).cast("double")


def behaviour_features(e: DataFrame) -> DataFrame:
    """Seven behaviour features: hashed IP and user, length, severity, field count, hour, weekday."""
    def bucket(col: Column) -> Column:
        return F.when(F.coalesce(col, F.lit("")) == "", 0.0).otherwise(F.pmod(F.xxhash64(col), F.lit(1000)) / 1000.0)

    return e.withColumns({
        "ip_hash": bucket(F.col("source.ip")),
        "user_hash": bucket(F.col("user.name")),
        "length": F.length(F.coalesce("message", F.lit(""))) / 1000.0,
        "severity_code": severity_code(F.col("severity")),
        "n_fields": F.greatest(F.coalesce(F.size("fields"), F.lit(0)), F.lit(0)) / 10.0,
        "hour": F.coalesce(F.hour("ts") / 24.0, F.lit(0.5)),
        "weekday": F.coalesce(F.weekday("ts") / 7.0, F.lit(0.5)),
    })


def tabular_features(e: DataFrame) -> DataFrame:
    """Hour, weekday, lower-cased categories, six numbers from the fields, message length and entropy.

    Categories stay text: they are coded by a fitted indexer, so that fit and use agree.
    """
    text = F.coalesce(F.nullif(F.col("message"), F.lit("")), F.col("raw_line"), F.lit(""))
    cols = {"f_hour": F.coalesce(F.hour("ts"), F.lit(0)).cast("double"),
            "f_weekday": F.coalesce(F.weekday("ts"), F.lit(0)).cast("double"),
            "f_length": F.length(text).cast("double"), "f_entropy": entropy(text)}
    for name in TABULAR_CATEGORIES:
        cols[f"c_{name}"] = F.lower(F.coalesce(F.col(name), F.lit("unknown")))
    for name in TABULAR_NUMBERS:
        value = field(F.col("fields"), name)
        cols[f"n_{name}"] = F.when(value.rlike(r"^\d*\.?\d+$"), value.try_cast("double")).otherwise(0.0)
    return e.withColumns(cols)
