"""Interval arithmetic on event time that stays balanced when one key holds most rows.

Plain range frames put a whole key into one task and rescan the frame for every row. The helpers below cut
each key into time slices as wide as the longest interval, so a hot key is spread over its slices, and use
running sums only, so each slice is read once in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.session import cut_lineage

#: Rows of a block of `row_blocks`, as a power of two.
BLOCK_BITS = 20


def _slice(us: Column, width: int) -> Column:
    return F.floor(us / F.lit(width)).cast("bigint")


def stab_count(
    intervals: DataFrame, probes: DataFrame, keys: list[str], width: int,
    lo: str = "lo", hi: str = "hi", weight: str = "weight", at: str = "at", out: str = "n",
) -> DataFrame:
    """For each distinct probe (keys, at): total weight of the intervals [lo, hi] of the same keys that hold it.

    No interval may be longer than ``width`` microseconds.
    """
    cut = intervals.select(
        *keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.col(weight).cast("bigint").alias("_w"),
        F.explode(F.sequence(_slice(F.col(lo), width), _slice(F.col(hi), width))).alias("_slice"),
    )
    opened = F.struct(F.greatest("_lo", F.col("_slice") * width).alias("pos"), F.col("_w").alias("step"))
    closed = F.struct((F.col("_hi") + 1).alias("pos"), (-F.col("_w")).alias("step"))
    ends_inside = _slice(F.col("_hi") + 1, width) == F.col("_slice")
    steps = cut.select(
        *keys, "_slice", F.inline(F.when(ends_inside, F.array(opened, closed)).otherwise(F.array(opened))),
    ).withColumn("_probe", F.lit(False))
    asked = probes.select(
        *keys, _slice(F.col(at), width).alias("_slice"), F.col(at).alias("pos"), F.lit(0).cast("bigint").alias("step"),
        F.lit(True).alias("_probe"),
    ).distinct()
    running = (
        Window.partitionBy(*keys, "_slice").orderBy("pos")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        steps.unionByName(asked)
        .withColumn(out, F.sum("step").over(running))
        .where("_probe")
        .select(*keys, F.col("pos").alias(at), out)
    )


def count_ahead(events: DataFrame, keys: list[str], us: str, width: int, out: str = "n") -> DataFrame:
    """For each distinct (keys, us): how many events of the keys lie in [us, us + width]."""
    per_time = events.groupBy(*keys, us).agg(F.count("*").alias("weight"))
    spans = per_time.select(*keys, (F.col(us) - width).alias("lo"), F.col(us).alias("hi"), "weight")
    return stab_count(spans, per_time.select(*keys, us), keys, width + 1, at=us, out=out)


def distinct_ahead(events: DataFrame, keys: list[str], value: str, us: str, width: int, out: str = "n") -> DataFrame:
    """For each distinct (keys, us): how many different values occur in [us, us + width].

    An occurrence counts for the window starts after the value's previous occurrence only, so each value
    is counted once per window and no set is ever built.
    """
    w = width + 1
    seen = events.select(*keys, value, us).distinct()
    placed = seen.select(
        *keys, value, us,
        F.explode(F.sequence(_slice(F.col(us) - width, w), _slice(F.col(us), w))).alias("_slice"),
    )
    before = Window.partitionBy(*keys, value, "_slice").orderBy(us)
    spans = placed.select(
        *keys, "_slice", F.col(us).alias("_us"), F.lag(us).over(before).alias("_prev"),
    ).select(
        *keys,
        F.greatest(F.col("_us") - width, F.coalesce(F.col("_prev") + 1, F.col("_us") - width), F.col("_slice") * w).alias("lo"),
        F.least(F.col("_us"), (F.col("_slice") + 1) * w - 1).alias("hi"),
        F.lit(1).alias("weight"),
    ).where("lo <= hi")
    return stab_count(spans, seen.select(*keys, us).distinct(), keys, w, at=us, out=out)


def next_within(
    left: DataFrame, right: DataFrame, us: str, width: int, right_id: str, keys: list[str] | None = None,
) -> DataFrame:
    """For each left row: the first right row (by time, then id) with 0 < right time - left time < width.

    Adds ``next_us`` and ``next_id``; left rows without such a row are dropped.
    """
    keys = keys or []
    lefts = left.withColumn("_slice", _slice(F.col(us), width)).withColumn("_left", F.lit(True))
    rights = right.groupBy(*keys, us).agg(F.min(right_id).alias("_rid")).select(
        *keys, F.col(us),
        F.struct(F.col(us).alias("us"), F.col("_rid").alias("id")).alias("_hit"),
        F.explode(F.array(_slice(F.col(us), width), _slice(F.col(us), width) - 1)).alias("_slice"),
        F.lit(False).alias("_left"),
    )
    later = (
        Window.partitionBy(*keys, "_slice").orderBy(F.col("_back")).rangeBetween(Window.unboundedPreceding, -1)
    )
    return (
        lefts.unionByName(rights, allowMissingColumns=True)
        .withColumn("_back", -F.col(us))
        .withColumn("_next", F.min("_hit").over(later))
        .where(F.col("_left") & (F.col("_next.us") - F.col(us) < width))
        .withColumns({"next_us": F.col("_next.us"), "next_id": F.col("_next.id")})
        .drop("_slice", "_left", "_hit", "_back", "_next")
    )


def previous_value(
    df: DataFrame, keys: list[str], order: str, value: str, width: int, out: str, ties: tuple[str, ...] = (),
) -> DataFrame:
    """Value of the row before, in the order of a numeric column (then ``ties``), over slices of that column.

    The last row of each slice is handed to the following slice that has rows, so the answer equals a lag
    over the whole key while no task sees more than one slice.
    """
    sliced = df.withColumn("_slice", _slice(F.col(order), width))
    newest = F.struct(F.col(order).alias("o"), *[F.col(t) for t in ties], F.col(value).alias("v"))
    last = sliced.groupBy(*keys, "_slice").agg(F.max(newest).alias("_last"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    carried = last.select(*keys, "_slice", F.lag("_last").over(by_slice).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order, *ties)
    joined = sliced.join(carried, [*keys, "_slice"], "left")
    return joined.withColumn(
        out,
        F.when(F.row_number().over(inside) == 1, F.col("_carry.v")).otherwise(F.lag(value).over(inside)),
    ).drop("_slice", "_carry")


def running_last(df: DataFrame, keys: list[str], order: str, value: Column, width: int, out: str) -> DataFrame:
    """Last non-null value at or before each row, in the order of a numeric column, over slices of it.

    What a slice inherits comes from a table with one row per slice, so a long key is never sorted in one task.
    """
    sliced = df.withColumns({"_slice": _slice(F.col(order), width), "_v": value})
    marked = F.when(F.col("_v").isNotNull(), F.struct(F.col(order).alias("o"), F.col("_v").alias("v")))
    last = sliced.groupBy(*keys, "_slice").agg(F.max(marked).alias("_last"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_slice", F.max("_last").over(by_slice).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = sliced.join(carried, [*keys, "_slice"], "left")
    return joined.withColumn(
        out, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry.v"))
    ).drop("_slice", "_v", "_carry")


def row_blocks(df: DataFrame, order: list[str], bits: int = BLOCK_BITS) -> DataFrame:
    """The rows with ``_at``, which rises in the given order, and ``_block``, numbers of runs of 2^bits rows at most.

    Rows are dealt out by ranges of the order, so neither a busy key nor a busy moment makes a large block. Written to
    shared storage, for the numbers follow the partitions.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return cut_lineage(placed.withColumn("_block", F.shiftright("_at", bits)))


def nearest_value(blocks: DataFrame, keys: list[str], value: Column, out: str, ahead: bool) -> DataFrame:
    """Nearest non-null value of the same keys at or before each row of ``row_blocks`` (ahead: at or after it).

    Inside a block by a running value; what a block inherits comes from a table with one row per key and block.
    """
    sign = -1 if ahead else 1
    rows = blocks.withColumns({"_v": value, "_turn": F.col("_at") * sign, "_side": F.col("_block") * sign})
    marked = F.when(F.col("_v").isNotNull(), F.struct("_turn", "_v"))
    last = rows.groupBy(*keys, "_side").agg(F.max(marked).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_side").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_side").alias("_s"), F.max("_last").over(before)["_v"].alias("_carry"))
    inside = Window.partitionBy(*keys, "_side").orderBy("_turn").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("_near", F.last("_v", ignorenulls=True).over(inside))
    same = F.col("_side") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = running.join(carried, same, "left")
    return joined.withColumn(out, F.coalesce("_near", "_carry")).drop("_v", "_turn", "_side", "_s", "_near", "_carry", *[f"_k{i}" for i, _ in enumerate(keys)])
