"""Token counts through a digest cache: every distinct content is encoded once per tokenizer version, ever."""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.llm.common import arrow_map, shared_folder, table, written
from tracehound.llm.skew import joined, rows_at_once

LIMIT = 1024
#: Characters that are encoded at once; a longer text is cut where no token can reach across.
AT_ONCE = 400_000
#: Byte-level patterns start a new word at a space behind a letter or digit, whatever stands around it.
EDGE = re.compile(r"(?<=\w) ")
#: Tokenizers of this worker, by version.
LOADED: dict = {}
CACHE = "digest binary, n_tokens long, tokenizer string"


class Tokenizer:
    """A tokenizer file as bytes, so that tasks need no path, its version, and counts by the file's own library.

    version: digest of the file, the library and its release; another of these never meets the stored counts.
    """

    def __init__(self, file: str | os.PathLike) -> None:
        import importlib.metadata

        with open(file, "rb") as f:
            self.data = f.read()
        self.library = "sentencepiece" if os.fspath(file).endswith(".model") else "tokenizers"
        release = importlib.metadata.version(self.library)
        self.version = hashlib.sha256(self.data + f"\0{self.library} {release}".encode()).hexdigest()
        self.normalises, self.cuts, self.marks = False, False, []
        if self.library == "tokenizers":
            parts = json.loads(self.data)
            self.marks = [t["content"] for t in parts["added_tokens"]]
            self.normalises = parts["normalizer"] is not None
            before, plain = parts["pre_tokenizer"] or {}, not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in parts["added_tokens"])
            self.cuts = plain and not self.normalises and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]

    def load(self, plain: bool = False):
        """The library's tokenizer, once a worker; plain: marks inside texts are ordinary text."""
        if (self.version, plain) not in LOADED:
            LOADED[self.version, plain] = self.made(plain)
        return LOADED[self.version, plain]

    def made(self, plain: bool):
        if self.library == "sentencepiece":
            import sentencepiece

            return sentencepiece.SentencePieceProcessor(model_proto=self.data)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import tokenizers

        made = tokenizers.Tokenizer.from_str(self.data.decode())
        made.no_truncation()
        made.no_padding()
        if plain:
            made.encode_special_tokens = True
        return made

    def content(self, text: str | None) -> str:
        """What decides the tokens: the text as the tokenizer normalises it; as it is, where a mark is in it, for marks are sought before."""
        if not text:
            return ""
        low = self.load().normalizer.normalize_str(text)
        return "raw:" + text if any(m in low or m in text for m in self.marks) else "as:" + low

    def lengths(self, texts: list[str]) -> list[int]:
        t = self.load()
        if self.library == "sentencepiece":
            return [len(x) for x in t.encode(texts, num_threads=1)]
        return [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text; null is as empty. Few texts, or parts of a long one, are encoded at once."""
        out, owner, held, size = [0] * len(texts), [], [], 0

        def flush() -> None:
            for k, n in zip(owner, self.lengths(held)):
                out[k] += n
            owner.clear()
            held.clear()

        for k, text in enumerate(texts):
            for part in self.parts(text or ""):
                if held and size + len(part) > AT_ONCE:
                    flush()
                    size = 0
                owner.append(k)
                held.append(part)
                size += len(part)
        flush()
        return out

    def parts(self, text: str):
        """The text, cut before spaces every AT_ONCE characters or so; tokens of the parts are those of the whole."""
        at = 0
        while self.cuts and len(text) - at > AT_ONCE and (edge := EDGE.search(text, at + AT_ONCE)):
            yield text[at : edge.start()]
            at = edge.start()
        yield text[at:]


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts of one tokenizer version in the cache table, a row a digest. A cache that is not there yet is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded_misses(misses: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, text) as (digest, n_tokens); a digest that comes twice in a task is encoded once."""
    sent = misses.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        done: set[bytes] = set()
        for batch in batches:
            fresh = [k for k, d in enumerate(batch.column("digest").to_pylist()) if not (d in done or done.add(d))]
            if len(done) > 1_000_000:
                done.clear()
            if fresh:
                part = batch.take(pa.array(fresh))
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(sent.value.counts(part.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, cache: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), by the tokenizer of tokenizer_file.

    cache: a table (digest, n_tokens, by tokenizer version) on storage that driver and executors share; made if it is not
    there. Contents are told apart by SHA-256 of the text as the tokenizer normalises it. Digests that the cache has
    no count for are encoded once, the row with the smallest id standing for all with that content, and appended; then
    every row takes its count from the cache. Only the texts of misses go through Python, and nothing goes to the driver.
    An append is committed as a whole; two jobs that append the same digest do no harm.

    Null texts are as empty: no bytes, no tokens. Texts are encoded whole, long ones in parts that have the same tokens.
    Null and repeated ids keep a row each; other columns are left out, whatever their names. An empty table gives none.
    """
    spark, folder, tokenizer = docs.sparkSession, shared_folder(docs.sparkSession), Tokenizer(tokenizer_file)
    rows = docs.select(docs[f"`{id_col}`"].alias("_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    if tokenizer.normalises:
        sent = spark.sparkContext.broadcast(tokenizer)
        with rows_at_once(spark):
            rows = written(arrow_map(rows, "text", lambda texts: {"content": [sent.value.content(t) for t in texts], "text": texts}, "content string, text string", keep=["_id"]), folder, "content")
    else:
        rows = rows.withColumn("content", F.col("text"))
    rows = rows.select("_id", "text", F.unhex(F.sha2("content", 256)).alias("digest"))
    listed = written(rows.select("_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), folder, "listed")
    groups = written(listed.groupBy("digest").agg(F.count("*").alias("n"), F.min("_id").alias("first")), folder, "groups")
    misses = groups.join(stored(spark, cache, tokenizer.version), "digest", "left_anti").select(F.col("digest").alias("_d"), "first")
    texts = rows.join(misses, (F.col("digest") == F.col("_d")) & F.col("_id").eqNullSafe(F.col("first")), "left_semi")
    with rows_at_once(spark):
        new = encoded_misses(texts, tokenizer).withColumn("tokenizer", F.lit(tokenizer.version))
        new.write.mode("append").partitionBy("tokenizer").parquet(cache)
    out = joined(listed, stored(spark, cache, tokenizer.version), "digest", groups.select("digest", "n"))
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    """The whole table through a cache that starts empty."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/cache", public_tokenizers.path("byte_bpe_50k.json"))
