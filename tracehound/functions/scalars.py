"""Scalar functions on text, numbers and bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracehound.rules import dims


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters of a text, in bits; 0 for an empty text.

    The code points are sorted as numbers and their runs folded: n log n in the length, whatever characters there are.
    """
    codes = F.sort_array(F.transform(F.split(text, ""), F.ascii))

    def added(acc: Column) -> Column:
        return acc["sum"] + F.when(acc["run"] > 1, acc["run"] * F.log2(acc["run"].cast("double"))).otherwise(0.0)

    def step(acc: Column, code: Column) -> Column:
        same = F.struct(code.alias("code"), (acc["run"] + 1).alias("run"), acc["sum"].alias("sum"))
        return F.when(code == acc["code"], same).otherwise(F.struct(code.alias("code"), F.lit(1).alias("run"), added(acc).alias("sum")))

    start = F.struct(F.lit(-1).alias("code"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    n = F.length(text).cast("double")
    return F.when(n > 0, F.log2(n) - F.aggregate(codes, start, step, added) / n).otherwise(F.lit(0.0))


def off_hours(ts: Column) -> Column:
    return (F.hour(ts) < 6) | (F.hour(ts) > 22)


def clip_unit(value: Column, low: Column | float, high: Column | float) -> Column:
    """Min-max scaling into 0..1."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(hi > lo, F.least(F.greatest((value - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def reason_names(reason: Column) -> Column:
    """Names of the set bits of a change-journal reason, lowest bit first; NONE when no known bit is set."""
    names = F.array_compact(
        F.array(*[
            F.when(reason.bitwiseAND(F.lit(bit).cast("bigint")) != 0, name)
            for bit, name in dims.USN_REASONS.items()
        ])
    )
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("NONE")))


def event_title(ip: Column, action: Column, user: Column, outcome: Column, severity: Column) -> Column:
    some = lambda c: c.isNotNull() & (c != "")
    return (
        F.when(some(ip) & some(action), F.concat_ws(" ", ip, action))
        .when(some(user), F.trim(F.concat_ws(" ", user, outcome)))
        .when(some(severity), F.concat(F.upper(severity), F.lit(" event")))
        .otherwise("Log Entry")
    )


def human_duration(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(F.format_string("%.0f", ms / 1000), F.lit("s")))
        .when(ms < 3600000, F.concat(F.format_string("%.0f", ms / 60000), F.lit("m")))
        .otherwise(F.concat(F.format_string("%.1f", ms / 3600000), F.lit("h")))
    )


def attack_stage(attack_type: Column, has_success: Column, has_failure: Column, n_sources: Column) -> Column:
    """Stage of a chain from its type, the outcomes seen and the number of log sources."""
    out = F.when(
        attack_type.isin("bruteforce", "password_spray"),
        F.when(has_success, "initial_access").otherwise("reconnaissance"),
    )
    for name, stage in dims.STAGES.items():
        out = out.when(attack_type == name, stage)
    return (
        out.when(n_sources > 2, "execution").when(has_success & ~has_failure, "complete").otherwise("execution")
    )


def advice(attack_type: Column, minutes: Column | None = None) -> Column:
    """Advice text of an attack type, led by the duration when there is one."""
    text = None
    for name, line in dims.ADVICE.items():
        text = F.when(attack_type == name, line) if text is None else text.when(attack_type == name, line)
    text = text.otherwise(dims.ADVICE_DEFAULT)
    if minutes is None:
        return text
    lead = F.when(minutes > 0, F.format_string("Attack occurred over %.1f minutes. ", minutes)).otherwise("")
    return F.concat(lead, text)


def correlation_score(severity: Column, progress: Column | float) -> Column:
    share = progress if isinstance(progress, Column) else F.lit(float(progress))
    score = None
    for name, value in dims.SEVERITY_SCORE.items():
        score = F.when(severity == name, value) if score is None else score.when(severity == name, value)
    return F.least(F.lit(0.5) + share * 0.5, score.otherwise(0.5))


def confidence_text(value: Column) -> Column:
    return F.concat(F.round(value * 100).cast("int").cast("string"), F.lit("%"))
