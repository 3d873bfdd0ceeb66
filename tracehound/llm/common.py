"""Helpers the operators of this subpackage share: words, tables, intermediate data on shared storage."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.session import shared_path

#: Characters between words, as a Java, RE2 and Python character class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times in `body`; Catalyst would else repeat it at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text, null as none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text, null as none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return let(trimmed, lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, SPACE + "+")))).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def seeded(seed: int, *parts: Column) -> Column:
    """A 60-bit number that depends on the seed and the parts only; other engines can state it too."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate data below the cluster's shared checkpoint folder (the warehouse, where none is set)."""
    return shared_path(spark, "llm")


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting that holds inside; what the session had before holds again afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage, survives lost executors, and later reads prune columns.

    What was shuffled for it goes from the executors' disks once it is written, not when the driver collects its garbage.
    """
    path = f"{folder}/{name}"
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def total(df: DataFrame, *columns: Column) -> tuple:
    """A few aggregates of a frame as Python values."""
    return tuple(df.agg(*columns).first())


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """Rows with the highest `c` (1 or more), `most` at most: whole steps of an eighth of a doubling, as many as fit.

    No task sees the top of every other task; the driver gets the sizes of the steps, a few hundred at most.
    """
    step = F.floor(F.log2(F.col("c").cast("double")) * 8)
    sizes = {r[0]: r[1] for r in counts.groupBy(step.alias("step")).count().collect()}
    lowest, held = None, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        lowest = k
    return counts.where(F.lit(False)) if lowest is None else counts.where(step >= lowest)


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows with the smallest hashes of their key. Rows are thinned by hash first, so that the task that orders them gets few more than it keeps."""
    n = rows.count()
    if n > 2 * most:
        unit = F.xxhash64(key) / F.lit(2.0**64) + 0.5
        rows = rows.where(unit < (most + 10 * most**0.5) / n)
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the session sets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(frames: Iterable, column: str, bytes_at_once: int = 8_000_000):
    """Arrow or pandas frames cut so that the texts of each hold about so many characters; a longer text stands alone."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > bytes_at_once:
                yield frame.iloc[start:i]
                start, held = i, 0
            held += n
        if start < len(frame):
            yield frame.iloc[start:]


#: A column name that tables do not have.
MADE = "__made_text__"


def arrow_map(df: DataFrame, text_col: str, work: Callable[[list], dict], columns: str, keep: Iterable[str] = ()) -> DataFrame:
    """Add columns made from each row's text by `work` (texts in, lists or Arrow arrays by column out), in tasks, batch by batch.

    The columns in `keep` pass through untouched, so nulls and large numbers stay as they are; one with the name of a new
    column is replaced by it.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    made = StructType.fromDDL(columns)
    keep = [c for c in keep if c not in made.names]
    chosen = df.select(*[df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)], df[f"`{text_col}`"].alias("text"))
    schema = StructType([f for f in chosen.schema if f.name != "text"] + made.fields)
    kept, names = [f"k{i}" for i, _ in enumerate(keep)], made.names

    def run(frames):
        for batch in frames:
            if batch.num_rows:
                out = work(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [x if isinstance(x := out[c], pa.Array) else pa.array(x) for c in names], kept + names)

    out = chosen.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names)


def with_text(docs: DataFrame, text_col: str, work: Callable[[list], list], chars_col: str = "n_chars") -> DataFrame:
    """The documents with each text as `work` makes it; chars_col, if there is one, counts the new text."""
    rest = [c for c in docs.columns if c != text_col]
    out = arrow_map(docs, text_col, lambda texts: {MADE: work(texts)}, f"{MADE} string", keep=rest)

    def column(name: str) -> Column:
        if name == text_col:
            return F.col(MADE).alias(name)
        if name == chars_col:
            return F.length(MADE).cast(docs.schema[name].dataType).alias(name)
        return F.col(f"`{name}`")

    return out.select(*[column(c) for c in docs.columns])
