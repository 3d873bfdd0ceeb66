"""URL filters: a sort-merge range join of reversed-host keys with rule intervals, with a stack of active nested rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.llm.common import let, lower_ascii, shared_folder, table, total, written

#: Rules of the registered query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SLICES = 64
START, URL, END = 0, 1, 2


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the top domain down: `a.b.org` as `org.b.a`."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", slices: int = SLICES, keep: Column | None = None) -> DataFrame:
    """Every row of `pages` as doc (the row, or `keep` of it), host, path, rule, rule_verdict, verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's path; the
    longest rule string wins. A rule given twice with both verdicts blocks. Null rule fields are as empty; a null
    verdict blocks. Null urls and urls without `://` have empty host and path and get the default, as all that fit no rule.

    A url has a key for each domain it lies below: the reversed domain, then the path. A rule is the interval of keys
    that start with its own, so rules of one domain nest. Urls and interval ends are sorted together; the running sum
    of starts less ends is the height of the stack, and its top is the last start that reached that height. Keys are
    dealt over slices, each with all rules of its domain, so a domain that holds most urls is swept in parts. Domains
    deeper than any rule's make no key.
    """
    doc = F.struct(*[pages[f"`{c}`"] for c in pages.columns]) if keep is None else keep
    urls = pages.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    urls = written(urls, shared_folder(pages.sparkSession), "urls")  # row numbers must be the same wherever they are read
    r = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit("block")).alias("verdict"))
    r = r.where("host != ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = total(r, F.max(F.size(F.split("host", r"\."))))[0] or 0

    domains = let(F.split("host", r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(max(labels, 1)))), lambda k: F.array_join(F.reverse(F.slice(p, F.size(p) - k + 1, k)), ".")))
    slice_of = F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")
    none = F.lit(None).cast("string")
    path_key = F.encode("path", "utf-8")
    keys = urls.where("host != ''").select(F.explode(domains).alias("domain"), slice_of.alias("slice"), path_key.alias("key"), F.lit(URL).alias("kind"), F.lit(0).alias("step"), "row", none.alias("rule"), none.alias("verdict"))
    dealt = r.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    rule = F.concat("host", "path").alias("rule")
    no_row = F.lit(None).cast("long").alias("row")
    starts = dealt.select(reversed_host(F.col("host")).alias("domain"), "slice", path_key.alias("key"), F.lit(START).alias("kind"), F.lit(1).alias("step"), no_row, rule, "verdict")
    last = F.concat(path_key, F.unhex(F.lit("FF")))  # a byte above all of UTF-8
    ends = dealt.select(reversed_host(F.col("host")).alias("domain"), "slice", last.alias("key"), F.lit(END).alias("kind"), F.lit(-1).alias("step"), no_row, none.alias("rule"), none.alias("verdict"))

    order = [F.col("key"), F.col("kind"), F.length("rule")]
    swept = Window.partitionBy("domain", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at_height = Window.partitionBy("domain", "slice", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    events = keys.unionByName(starts).unionByName(ends).withColumn("height", F.sum("step").over(swept))
    top = F.last(F.when(F.col("kind") == START, F.struct(F.length("rule").alias("size"), "rule", "verdict")), ignorenulls=True).over(at_height)
    found = events.withColumn("top", F.when(F.col("height") > 0, top)).where((F.col("kind") == URL) & F.col("top").isNotNull())
    best = found.groupBy("row").agg(F.max("top").alias("top"))
    out = urls.join(best, "row", "left")
    return out.select("doc", "host", "path", F.col("top.rule").alias("rule"), F.col("top.verdict").alias("rule_verdict"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = judge_urls(pages, rules, keep=pages["page_id"])
    return out.select(F.col("doc").alias("page_id"), "host", "path", "rule", "verdict")


SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT row_number() OVER () AS row, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT p.row, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.row ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC) AS n
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.row = f.row AND f.n = 1
"""
