"""Continuous parsing, alerts over event-time windows, live statistics, duplicate removal."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.operators import detect, parsing
from tracehound.schema import MINUTE, is_auth_event, micros
from tracehound.session import shared_path


def stream_entries(lines: DataFrame, default_year: int, force_type: str | None = None) -> DataFrame:
    """Lines of a stream to tagged entries, row by row with the batch code."""
    return detect.tag_keywords(parsing.to_entries(parsing.parse(lines, default_year, force_type)))


def drop_resent(entries: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Entries without those sent again within the delay. An id is forgotten at the end of the first batch behind it."""
    return entries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def window_counts(entries: DataFrame, delay: str = "10 minutes", length: str = "5 minutes", step: str = "1 minute", parts: int = 16) -> DataFrame:
    """Exact counts per IP and event-time window, in parts: (ip, window_start, window_end, slot, events, failures, users, ports).

    For update mode; counts of a part only grow, and those of a window are the sums over its parts (see ``alerts_of``). An
    entry goes to the part of its user, where it counts, and to the part of its port, so every user and port is in one part and
    sums are exact. State is one row per (IP, window, part) with the different failing users or ports seen there: a name
    or 8 bytes each, 65,536 ports at most per window, users dealt over ``parts`` rows, so a hot IP is not one row.
    """
    fail = F.coalesce((F.col("outcome") == "failure") & is_auth_event(), F.lit(False))
    rows = entries.withWatermark("ts", delay).where("source.ip IS NOT NULL").select(
        "ts", F.col("source.ip").alias("ip"), fail.alias("fail"), F.explode(F.array(
            F.struct(F.lit("user").alias("kind"), F.col("user.name").alias("value")), F.struct(F.lit("port").alias("kind"), F.col("source.port").cast("string").alias("value")),
        )).alias("x"),
    ).where("x.kind = 'user' OR x.value IS NOT NULL")
    user = F.col("x.kind") == "user"
    slot = F.concat_ws("-", "x.kind", F.pmod(F.xxhash64("x.value"), F.lit(parts)).cast("string"))
    g = rows.groupBy(F.window("ts", length, step).alias("w"), "ip", slot.alias("slot")).agg(
        F.count_if(user).alias("events"), F.count_if(user & F.col("fail")).alias("failures"),
        F.size(F.collect_set(F.when(user & F.col("fail"), F.col("x.value")))).cast("bigint").alias("users"),
        F.size(F.collect_set(F.when(~user, F.col("x.value").cast("bigint")))).cast("bigint").alias("ports"),
    )
    return g.select("ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "slot", "events", "failures", "users", "ports")


COUNTS = ["events", "failures", "users", "ports"]


def alerts_of(counts: DataFrame, failures: int = 10, users: int = 10, ports: int = 10, events: int = 10) -> DataFrame:
    """Threshold alerts per IP and window from what ``window_counts`` has told so far: brute force, spray, port scan, burst."""
    newest_parts = counts.groupBy("ip", "window_start", "window_end", "slot").agg(*[F.max(c).alias(c) for c in COUNTS])
    g = newest_parts.groupBy("ip", "window_start", "window_end").agg(*[F.sum(c).alias(c) for c in COUNTS])
    kinds = F.array_compact(F.array(
        F.when(F.col("failures") >= failures, F.struct(F.lit("bruteforce").alias("type"), F.col("failures").alias("hits"))),
        F.when(F.col("users") >= users, F.struct(F.lit("password_spray").alias("type"), F.col("users").alias("hits"))),
        F.when(F.col("ports") >= ports, F.struct(F.lit("port_scan").alias("type"), F.col("ports").alias("hits"))),
        F.when(F.col("events") >= events, F.struct(F.lit("burst").alias("type"), F.col("events").alias("hits"))),
    ))
    return g.select("ip", "window_start", "window_end", F.inline(kinds))


def alert_batches(path: str, **thresholds: int) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` on ``window_counts``: alerts of the windows that changed in each micro-batch, under ``path``.

    Counts are kept by day of their window, so a batch reads back the days it touches only. Files are named by batch: one
    that is run again overwrites its own.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("day", F.to_date("window_start"))
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{path}/counts/batch={batch_id}")
        mine = spark.read.schema(dated.schema).parquet(f"{path}/counts/batch={batch_id}")
        days = mine.agg(F.min("day").alias("low"), F.max("day").alias("high"))
        known = spark.read.parquet(f"{path}/counts").where(F.col("day").between(days.select("low").scalar(), days.select("high").scalar()))
        changed = mine.select("ip", "window_start").distinct()
        alerts_of(known.join(changed, ["ip", "window_start"], "left_semi"), **thresholds).write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")

    return run


def _counted(width: int, n: int, keep: int):
    """Per (bucket of users, slice): how many failures of the window each success has behind it, told anew whenever that grows.

    State holds a count for each user and time of a failure, and the successes of the slice. Users become small numbers,
    so (user, time) is one number and every window two searches in a sorted array, for all users of the bucket at once.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [list(x) for x in state.get] if state.exists else [[] for _ in range(7)]
        for pdf in frames:
            bad = pdf["failed"].to_numpy(bool)
            held[0] += pdf.loc[bad, "user"].tolist()
            held[1] += pdf.loc[bad, "us"].tolist()
            held[2] += [1] * int(bad.sum())
            held[3] += pdf.loc[~bad, "user"].tolist()
            held[4] += pdf.loc[~bad, "id"].tolist()
            held[5] += pdf.loc[~bad, "us"].tolist()
            held[6] += [0] * int((~bad).sum())
        names, code = np.unique(np.array(held[0] + held[3], object).astype(str), return_inverse=True)
        base, span, fails = (int(key[1]) - 1) * width, 2 * width, len(held[0])
        spot = code[:fails] * span + np.array(held[1], np.int64) - base
        spot, place = np.unique(spot, return_inverse=True)
        times = np.bincount(place, weights=held[2], minlength=len(spot)).astype(np.int64) if fails else np.empty(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(times)])
        at = code[fails:] * span + np.array(held[5], np.int64) - base
        counts = upto[np.searchsorted(spot, at)] - upto[np.searchsorted(spot, at - width)]
        told = np.array(held[6], np.int64)
        grown = np.flatnonzero((counts >= n) & (counts > told))
        told[grown] = counts[grown]
        state.update((names[spot // span].tolist(), (spot % span + base).tolist(), times.tolist(), held[3], held[4], held[5], told.tolist()))
        end = (int(key[1]) + 1) * width // 1000 + keep
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        pick = lambda x: [x[i] for i in grown]
        yield pd.DataFrame({"user": pick(held[3]), "id": pick(held[4]), "us": pick(held[5]), "failures": counts[grown]})

    return run


def success_after_failures(entries: DataFrame, n: int = 3, minutes: float = 10, delay: str = "10 minutes", buckets: int = 64) -> DataFrame:
    """Each success with ``n`` failures or more of the same user in the ``minutes`` before it, across batches: (user, id, us, failures).

    For update mode: a success is told again when failures that came late raise its count, so the row with the highest
    count is the newest. State is kept by (bucket of users, time slice) until the watermark has passed the slice; a failure
    is also kept in the next slice, so a busy user is spread over slices and no pairs are formed. A call serves all users
    of a bucket; take more buckets for more users, as a bucket's slice is one cell of state.
    """
    width = int(minutes * MINUTE)
    auth = entries.where(F.col("user.name").isNotNull() & is_auth_event() & F.col("outcome").isin("failure", "success") & F.col("ts").isNotNull()).withWatermark("ts", delay)
    failed, home = F.col("outcome") == "failure", F.floor(micros() / width)
    user = F.col("user.name")
    rows = auth.select(
        user.alias("user"), F.pmod(F.xxhash64(user), F.lit(buckets)).alias("bucket"), F.explode(F.when(failed, F.array(home, home + 1)).otherwise(F.array(home))).alias("slice"),
        "id", micros().alias("us"), failed.alias("failed"), "ts")
    return rows.groupBy("bucket", "slice").applyInPandasWithState(
        _counted(width, n, width // 1000), "user STRING, id STRING, us BIGINT, failures BIGINT",
        "fail_users ARRAY<STRING>, fail_times ARRAY<BIGINT>, fail_counts ARRAY<BIGINT>, users ARRAY<STRING>, ids ARRAY<STRING>, wins ARRAY<BIGINT>, told ARRAY<BIGINT>", "update", "EventTimeTimeout",
    )


def newest(out: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The highest, and so the newest, value of each key in what an update stream has told."""
    return out.groupBy(*keys).agg(F.max(value).alias(value))


def live_stats(entries: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Entries per minute, log type and outcome."""
    return entries.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute").alias("w"), "log_type", "outcome").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("minute"), "log_type", "outcome", "n"
    )


def detect_batches(path: str, cfg: detect.DetectionConfig = detect.DetectionConfig()) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: alerts and counters of each micro-batch as files under ``path``.

    Files are named by batch, so a batch that is run again overwrites its own results.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            alerts = detect.run_detections(batch, cfg)
            alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")
            batch.agg(F.count("*").alias("entries"), F.count_if(F.col("outcome") == "failure").alias("failures")).write.mode("overwrite").parquet(f"{path}/counters/batch={batch_id}")
        finally:
            batch.unpersist()

    return run


def running_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/counters").agg(F.countDistinct("batch").alias("batches"), F.sum("entries").alias("entries"), F.sum("failures").alias("failures"))


def replayed(rows: DataFrame, batches: int, again: int = 0) -> DataFrame:
    """The rows as a stream of micro-batches in order of ``ts``, each with what came ``again`` batches before sent once more.

    Batches are equal spans of time, written to shared storage as a file source reads them, by all tasks.
    """
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession, "replay")
    at = F.unix_micros("ts")
    low, high = (rows.agg(f(at).alias("v")).scalar() for f in (F.min, F.max))
    step = F.greatest(F.ceil((high - low + 1) / batches), F.lit(1))
    dated = rows.withColumn("_batch", F.least(F.floor((at - low) / step), F.lit(batches - 1)).cast("int"))
    if again:
        dated = dated.unionByName(dated.withColumn("_batch", F.col("_batch") + again).where(F.col("_batch") < batches))
    return as_stream([dated.where(F.col("_batch") == k).drop("_batch") for k in range(batches)], folder)


FILE_ROWS = 50_000


def as_stream(frames: list[DataFrame], folder: str) -> DataFrame:
    """Frames as a stream of one micro-batch each, in this order: the file times, by which a file source goes, are set a second apart.

    Each task of a frame writes its own files, of ``FILE_ROWS`` rows at most, so no reader has to take more at once. A file
    source takes the same number of files for every batch, so copies of one file without rows make up the difference.
    """
    spark = frames[0].sparkSession
    jvm, conf, start = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), int(time.time()) - len(frames)
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    parts = lambda name: [p for p in (s.getPath() for s in fs.listStatus(at(name))) if p.getName().startswith("part-")]
    frames[0].limit(0).write.parquet(f"{folder}/_none")  # names with an underscore are no input
    for k, frame in enumerate(frames):
        frame.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/{k:04d}")
    written = [len(parts(f"{k:04d}")) for k in range(len(frames))]
    none, most = parts("_none")[0], max(written)
    for k, n in enumerate(written):
        for i in range(n, most):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, none, fs, at(f"{k:04d}/part-none-{i:05d}.parquet"), False, conf)
        for path in parts(f"{k:04d}"):
            fs.setTimes(path, (start + k) * 1000, -1)
    files = {"maxFilesPerTrigger": most, "maxCachedFiles": most * len(frames), "recursiveFileLookup": "true"}
    return spark.readStream.schema(frames[0].schema).options(**files).parquet(folder)


def work_folder(spark: SparkSession, name: str) -> str:
    """New folder below the shared checkpoint folder for a stream's output and state."""
    return shared_path(spark, name)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: off the heap, with changes written per batch."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_available(df: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over all data that is there, with its state in RocksDB, and give its output as a frame."""
    with rocksdb(df.sparkSession):
        return _run_available(df, mode, name)


def _run_available(df: DataFrame, mode: str, name: str) -> DataFrame:
    spark = df.sparkSession
    folder = work_folder(spark, name)
    if mode == "append":
        q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    else:
        # changed rows of each batch; a reader keeps the newest row of each key
        write = lambda batch, i: batch.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/out/part={i}")
        q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out") if mode == "append" else spark.read.parquet(f"{folder}/out").drop("part")
