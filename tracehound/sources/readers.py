"""Readers: log lines, named sources, JSON, CSV, event XML, file artifacts, labelled flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracehound.functions.normalize import found, normalize_ts
from tracehound.rules import dims


#: Splits of files up to which their offsets are broadcast; beyond it, they join by shuffle.
SPLITS = 100_000


def read_lines(spark: SparkSession, path: str | list[str], keep_blank: bool = False) -> DataFrame:
    """(source, line_no, line) of text files; bytes that are not UTF-8 are dropped.

    Files are split as usual, and no file is read by one task: rows are numbered without gaps inside a split, so a
    line's number is its row number less the first of its split, plus the lines of the splits before it in the same
    file. Only the small table of splits is shuffled, not the text.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")).alias("line"),
    )
    splits = raw.groupBy("source", "_split").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("source").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("source", "_split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    few = offsets.count() <= SPLITS
    out = raw.join(F.broadcast(offsets) if few else offsets, ["source", "_split"]).select("source", (F.col("_offset") + F.col("_at")).alias("line_no"), "line")
    return out if keep_blank else out.where(F.trim(F.col("line")) != "")


def read_sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several named sources as one frame, each row with its source name."""
    frames = [read_lines(spark, p).withColumn("source_name", F.lit(name)) for name, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def tag_sources(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("source_name", F.lit(n)) for n, df in frames.items()])


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source_name").agg(F.count("*").alias("n"))


def explode_json_array(df: DataFrame, col: str = "line") -> DataFrame:
    """A line that is a JSON array becomes one line per element; arrays of arrays are flattened once; other lines stay."""
    text = F.trim(F.col(col))
    is_array = F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]"))
    outer = F.when(is_array, F.from_json(text, "array<string>"))
    nested = F.exists(outer, lambda x: F.startswith(F.ltrim(x), F.lit("[")))
    flat = F.when(nested, F.flatten(F.transform(outer, lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array(x))))).otherwise(outer)
    lines = F.when(is_array & outer.isNotNull(), flat).otherwise(F.array(F.col(col)))
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.posexplode(lines).alias("element_no", col))


# Keys under which JSON logs keep the same thing.
JSON_KEYS = {
    "timestamp": ["timestamp", "time", "date"], "source_ip": ["source_ip", "sourceIp"], "user": ["user", "username"],
    "action": ["action"], "outcome": ["outcome", "status"], "severity": ["severity", "level"], "log_type": ["log_type", "logType", "level"],
}
JSON_DEFAULTS = {"severity": "info", "log_type": "json"}


def parse_json_lines(df: DataFrame, col: str = "line") -> DataFrame:
    """Common columns of JSON lines, first of the known keys; lines that are no JSON object are dropped."""
    schema = ", ".join(f"{k} STRING" for k in dict.fromkeys(k for ks in JSON_KEYS.values() for k in ks))
    parsed = F.from_json(F.col(col), schema)
    objects = df.where(F.ltrim(F.col(col)).startswith("{") & (F.json_object_keys(F.col(col)).isNotNull())).withColumn("_j", parsed)
    out = {}
    for name, keys in JSON_KEYS.items():
        tries = [F.nullif(F.col(f"_j.{k}"), F.lit("")) for k in keys]
        if name in JSON_DEFAULTS:
            tries.append(F.lit(JSON_DEFAULTS[name]))
        out[name] = F.coalesce(*tries)
    return objects.withColumns({k: v for k, v in out.items()}).drop("_j")


WINDOWS_CSV = {
    "security": ["TimeCreated", "EventID", "LevelDisplayName", "LogName", "MachineName", "Message", "AccountName", "LogonType", "IpAddress"],
    "application": ["TimeCreated", "EventID", "LevelDisplayName", "LogName", "MachineName", "ProviderName", "Message"],
}


def read_windows_csv(spark: SparkSession, path: str, kind: str = "security") -> DataFrame:
    """Windows event CSV with quoted messages; repeated header rows are dropped with every row without a time."""
    schema = ", ".join(f"{c} STRING" for c in WINDOWS_CSV[kind])
    return windows_rows(spark.read.csv(path, schema=schema, header=False, quote='"', escape='"', multiLine=False), kind)


def windows_rows(df: DataFrame, kind: str = "security") -> DataFrame:
    level = F.lower(F.trim("LevelDisplayName"))
    cols = [
        normalize_ts(F.col("TimeCreated"), 1970).alias("ts"), F.coalesce(F.col("EventID").try_cast("int"), F.lit(0)).alias("event_id"),
        level.alias("level"),
        F.when(level.isin("error", "failure", "audit failure"), "error").when(level == "warning", "warning").otherwise("info").alias("severity"),
        F.trim("LogName").alias("log_name"), F.trim("MachineName").alias("machine_name"), F.trim("Message").alias("message"),
    ]
    if kind == "security":
        cols += [F.trim("AccountName").alias("account_name"), F.trim("LogonType").alias("logon_type"), F.trim("IpAddress").alias("ip")]
    else:
        cols += [F.trim("ProviderName").alias("provider_name")]
    return df.where(F.col("TimeCreated").rlike(r"^\s*\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}")).select(*cols)


EVENT_XML = "System STRUCT<EventID: STRING, Level: STRING, Computer: STRING, Channel: STRING, EventRecordID: BIGINT, TimeCreated: STRUCT<_SystemTime: STRING>>, EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>"


def read_event_xml(spark: SparkSession, path: str) -> DataFrame:
    """Event log XML, one row per Event element."""
    return _events(spark.read.format("xml").option("rowTag", "Event").schema(EVENT_XML).load(path).select(F.struct("System", "EventData").alias("x")))


def parse_event_xml(df: DataFrame, col: str = "xml") -> DataFrame:
    """The same from a column that holds one Event element per row."""
    keep = [c for c in df.columns if c != col]
    return _events(df.select(*keep, F.from_xml(F.col(col), EVENT_XML).alias("x")), keep)


def _events(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    levels = F.create_map(*[F.lit(v) for kv in dims.EVENT_LEVELS.items() for v in kv])
    data = F.coalesce(F.col("x.EventData.Data"), F.array().cast("array<struct<_Name:string,_VALUE:string>>"))
    # the last value of each name, by one fold that drops a name before it is set again
    none = F.array().cast("array<struct<_Name:string,_VALUE:string>>")
    last = F.aggregate(data, none, lambda acc, d: F.array_append(F.filter(acc, lambda x: ~x["_Name"].eqNullSafe(d["_Name"])), d))
    return df.select(
        *(keep or []), F.col("x.System.EventRecordID").alias("record_id"), F.col("x.System.EventID").try_cast("int").alias("event_id"),
        F.try_to_timestamp(F.col("x.System.TimeCreated._SystemTime")).alias("ts"), F.col("x.System.Computer").alias("computer"),
        F.col("x.System.Channel").alias("channel"),
        F.coalesce(F.element_at(levels, F.col("x.System.Level")), F.col("x.System.Level"), F.lit("Information")).alias("level"),
        F.map_from_entries(F.transform(
            F.filter(last, lambda d: d["_Name"].isNotNull()), lambda d: F.struct(d["_Name"].alias("k"), F.coalesce(d["_VALUE"], F.lit("")).alias("v"))
        )).alias("event_data"),
    )


TIMELINE_COLUMNS = ["type", "filename", "modified", "accessed", "mft_modified", "created"]


def read_file_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated file timeline."""
    return parse_file_timeline(spark.read.text(path).select(F.col("value").alias("line")))


def parse_file_timeline(df: DataFrame, col: str = "line") -> DataFrame:
    """Rows of a timeline listing: banner rows dropped, zone suffix removed, one row per (name, created, modified)."""
    line = F.col(col)
    cells = F.split(line, "\t")
    banner = F.startswith(line, F.lit("=")) | line.rlike(r"^(Full Timeline|Image:|Offset:)") | (F.trim(line) == "")
    rows = df.where(~banner & (F.size(cells) >= 6) & F.contains(F.get(cells, F.lit(2)), F.lit(":"))).select(
        F.trim(F.get(cells, F.lit(0))).alias("type"), F.trim(F.get(cells, F.lit(1))).alias("filename"),
        *[F.trim(F.substring_index(F.get(cells, F.lit(i)), " (", 1)).alias(TIMELINE_COLUMNS[i]) for i in range(2, 6)],
    )
    return rows.where("filename <> '' AND (modified <> '' OR created <> '')").dropDuplicates(["filename", "created", "modified"])


def read_usn_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_usn_text(spark.read.text(path).select(F.col("value").alias("line")))


def parse_usn_text(df: DataFrame, col: str = "line") -> DataFrame:
    """Change-journal listing: time and raw text of each line that has a time."""
    line = F.col(col)
    stamp = found(line, r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})")
    skip = F.startswith(line, F.lit("=")) | F.contains(line, F.lit("No USN"))
    return df.where(~skip & stamp.isNotNull()).select(
        F.try_to_timestamp(F.regexp_replace(stamp, r"\s+", " "), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), line.alias("raw")
    )


def partition_of(path: Column) -> Column:
    """Disk partition number in a file name like ``timeline_partition_2.txt``."""
    return found(path, r"_partition_(\d+)\.").try_cast("int")


def load_artifacts(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """Listings of an artifact folder per kind, each row with its partition number."""
    kinds = ["timeline", "usn_journal", "mft", "logs", "registry", "shadow_copies", "hidden_structures"]
    out = {}
    for kind in kinds:
        lines = spark.read.text(directory, pathGlobFilter=f"{kind}_partition_*.txt", recursiveFileLookup=True)
        out[kind] = lines.select(partition_of(F.col("_metadata.file_path")).alias("partition"), F.lit(kind).alias("listing"), F.col("value").alias("line"))
    return out


def event_bounds(events: DataFrame, by: str | None = None) -> DataFrame:
    """First and last event time, overall or per channel."""
    g = events.groupBy(by) if by else events.groupBy()
    return g.agg(F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count("*").alias("events"))


def load_flow_dataset(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Labelled flow CSV in the common sample schema."""
    return flow_samples(spark.read.csv(path, header=True), kind)


def flow_samples(df: DataFrame, kind: str) -> DataFrame:
    """Categories mapped to attack types, harmless rows dropped, one sample schema for all datasets."""
    mapping = df.sparkSession.createDataFrame(list(dims.FLOW_TYPES[kind].items()), "attack_category STRING, mapped STRING")
    if kind == "unsw_nb15":
        category = F.trim(F.coalesce("attack_cat", F.lit("Normal")))
        rows = df.withColumn("attack_category", category).where(
            (F.coalesce(F.col("label").try_cast("int"), F.lit(0)) != 0) & (F.col("attack_category") != "Normal")
        )
        message = F.format_string(
            "%s flow from %s:%s to %s:%s dur=%.2fs bytes=%s", F.coalesce("proto", F.lit("TCP")), F.coalesce("srcip", F.lit("0.0.0.0")), F.coalesce("sport", F.lit("0")),
            F.coalesce("dstip", F.lit("0.0.0.0")), F.coalesce("dsport", F.lit("0")), F.coalesce(F.col("dur").try_cast("double"), F.lit(0.0)), F.coalesce("sbytes", F.lit("0")),
        )
        source, dest, proto = F.col("srcip"), F.col("dstip"), F.upper("proto")
        severity = F.lit("warning")
    else:
        rows = df.withColumn("attack_category", F.trim(F.coalesce("Label", F.lit("BENIGN")))).where("attack_category <> 'BENIGN'")
        message = F.format_string(
            "Flow duration=%s packets=%s fwd %s bwd", F.coalesce(F.col("`Flow Duration`"), F.lit("0")), F.coalesce(F.col("`Total Fwd Packets`"), F.lit("0")),
            F.coalesce(F.col("`Total Backward Packets`"), F.lit("0")),
        )
        source, dest, proto = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("TCP")
        severity = F.when(F.contains("attack_category", F.lit("DDoS")), "critical").otherwise("warning")
    return rows.join(F.broadcast(mapping), "attack_category", "left").select(
        source.alias("source_ip"), dest.alias("destination_ip"), proto.alias("protocol"), message.alias("message"),
        F.coalesce("mapped", F.lit("unknown")).alias("attack_type"), "attack_category", severity.alias("severity"), F.lit(kind).alias("dataset"),
    )


def training_set(*samples: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), samples)


def type_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("attack_type").agg(F.count("*").alias("n"))
