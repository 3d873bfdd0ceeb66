"""Quality rules: lines are judged first, failing lines go, then documents that lose too much text go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import NOT_SPACE, SPACE, let, table, words

SYMBOLS = r"[#*$%&|<>]"
#: A line of prose ends with one of these, closing quotes and brackets aside.
TERMINAL = r"[.!?:;…。！？][\"'”’»)\]]*" + SPACE + r"*$"
NAVIGATION = r"(\|" + SPACE + r"*[^|]*){2,}|(»" + SPACE + r"*[^»]*){2,}|(>" + SPACE + r"+[^>]*){2,}"
BOILERPLATE = (
    r"(?i)(all rights reserved|accept (all )?cookies|uses cookies|cookie policy|privacy policy|terms of (use|service)|click here to"
    r"|sign up for|subscribe to our|javascript is disabled|enable javascript|share this (page|article)|back to top|skip to content)"
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Percent of a document's words that may go with failing lines.
MAX_LOST_PERCENT = 50
#: Symbols per hundred words at which a line is junk.
MAX_LINE_SYMBOL_PERCENT = 30
#: A line without terminal punctuation fails below this many words; longer ones are cut prose and stay.
MIN_OPEN_WORDS = 6


def repeated_words(w: Column) -> Column:
    """Words in three-word windows that stand twice or more in the array, their first time included.

    Windows are hashed (64 bits), sorted with their places, and compared with their neighbours: n log n in the words.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
        return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["upto"])).alias("n"), (i + 3).alias("upto")))["n"]

    return F.when(F.size(w) < 4, 0).otherwise(let(F.sort_array(windows), covered)).cast("long")


def line_fails(line: Column, max_symbols: int = MAX_LINE_SYMBOL_PERCENT) -> Column:
    """Whether a line with a word is navigation, boilerplate, symbols, shouting, or a short scrap without an end."""

    def judged(n: Column) -> Column:
        symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
        shouting = (n >= 3) & (F.lower(line) != line) & (F.upper(line) == line)
        return (
            (symbols * 100 >= n * max_symbols) & (symbols >= 2)
            | shouting
            | ((n < MIN_OPEN_WORDS) & ~line.rlike(TERMINAL))
            | (line.rlike(NAVIGATION) & ~line.rlike(TERMINAL))
            | ((n <= 40) & line.rlike(BOILERPLATE))
        )

    return let(F.size(F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), SPACE + "+")), judged)


def judge(docs: DataFrame, text_col: str = "text", max_lost: int = MAX_LOST_PERCENT, min_words: int = MIN_WORDS, keep: Column | None = None) -> DataFrame:
    """Every row as doc (the row, or `keep` of it), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept, clean.

    clean is the text without its failing lines; lines without a word stay. Null and empty text has counts of 0, fails the base and is clean as
    itself. Texts of any length are judged whole, repeated rows alike; other columns pass through in `doc` whatever their names. No shuffle.
    """
    doc = F.struct(*[docs[f"`{c}`"] for c in docs.columns]) if keep is None else keep
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(doc.alias("doc"), docs[text_col].alias("raw"), text.alias("text"), words(docs[text_col]).alias("w"), F.split(text, "\n").alias("lines"))

    def facts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    def line_facts(lines: Column) -> Column:
        solid = F.filter(lines, lambda x: x.rlike(NOT_SPACE))
        kept = F.filter(lines, lambda x: ~x.rlike(NOT_SPACE) | ~line_fails(x))
        return F.struct(let(solid, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"), F.array_join(kept, "\n").alias("clean"))

    rows = rows.select("doc", "raw", "text", let(F.col("w"), facts).alias("f"), let(F.col("lines"), line_facts).alias("l"))
    chars = F.length(F.regexp_replace("text", SPACE + "+", "")).cast("long")
    symbols = (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS + "+", ""))).cast("long")
    out = rows.select(
        "doc", F.col("f.n_words").alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), F.col("l.n_dup_lines").alias("n_dup_lines"),
        F.col("f.n_repeat_words").alias("n_repeat_words"), F.when(F.col("raw").isNotNull(), F.col("l.clean")).alias("clean"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    left = F.coalesce(F.length(F.regexp_replace("clean", SPACE + "+", "")), F.lit(0))
    out = out.withColumn("lost_chars", (F.col("word_chars") - left).cast("long"))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost * F.col("word_chars")))


def cleaned(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The documents the rules keep, without their failing lines; chars_col, if there is one, counts the new text."""
    out = judge(docs, text_col, **options).where("kept")

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("clean").alias(name)
        if name == chars_col:
            return F.length("clean").cast(docs.schema[name].dataType).alias(name)
        return F.col("doc")[name].alias(name)

    return out.select(*[column(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = judge(docs, keep=docs["doc_id"])
    return out.select(F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, unnest(regexp_extract_all(text, '{NOT_SPACE}+')) AS w, generate_subscripts(regexp_extract_all(text, '{NOT_SPACE}+'), 1) AS i FROM d),
t AS (SELECT row, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY row ORDER BY i)),
g AS (SELECT row, i, g IS NOT NULL AND count(*) OVER (PARTITION BY row, g) > 1 AS twice FROM t),
r AS (SELECT row, i, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit FROM g WINDOW o AS (PARTITION BY row ORDER BY i)),
n AS (SELECT row, count(*) AS n_words, count(*) FILTER (hit) AS n_repeat_words FROM r GROUP BY row),
l AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT row, line, len(regexp_extract_all(line, '{NOT_SPACE}+')) AS n FROM l WHERE regexp_matches(line, '{NOT_SPACE}')),
j AS (SELECT *, len(line) - len(regexp_replace(line, '{SYMBOLS}', '', 'g')) AS s, regexp_matches(line, '{TERMINAL.replace("'", "''")}') AS ended FROM k),
f AS (SELECT row, line, (s * 100 >= n * {MAX_LINE_SYMBOL_PERCENT} AND s >= 2) OR (n >= 3 AND lower(line) <> line AND upper(line) = line) OR (n < {MIN_OPEN_WORDS} AND NOT ended)
      OR (regexp_matches(line, '{NAVIGATION}') AND NOT ended) OR (n <= 40 AND regexp_matches(line, '{BOILERPLATE}')) AS fails FROM j),
c AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(len(regexp_replace(line, '{SPACE}+', '', 'g'))) FILTER (fails), 0) AS lost_chars FROM f GROUP BY row),
b AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, len(regexp_replace(text, '{SPACE}+', '', 'g')) AS word_chars, len(text) - len(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars FROM d LEFT JOIN n USING (row) LEFT JOIN c USING (row)),
e AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept, lost_chars::BIGINT AS lost_chars FROM e
"""
