"""String tests before patterns: they may let a text pass that a pattern does not match, never the other way round."""

import random
import re
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracehound.functions import normalize as nz
from tracehound.functions import prefilter as pre
from tracehound.operators import parsing as ps
from tracehound.plans.views import raw_lines
from tracehound.rules import attacks
from tracehound.rules.formats import LINE_TESTS, RAW, start_anchored

PATTERNS = [start_anchored(a) if k == "re" else a for _, k, a in LINE_TESTS if k in ("re", "find")]
PATTERNS += ["(?i)" + p for _, _, group in attacks.KEYWORD_RULES for p in group] + [attacks.category_pattern(p) for *_, group in attacks.CATEGORY_RULES for p in group]
KNOWN = [p for p in PATTERNS if pre._parsed(p) is not None]
PIECES = [s for p in KNOWN for c in pre.needed(p)[1] for s in c] + ["2024-01-02", " 03:04:05", "Jan  5 ", "10.0.0.1", " - - ", "[", "]", '"', " ", "/x", " 200 17", "\t", "'", "=", "(", ")", "ſ", "K", "İ"]


@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=8))
@settings(max_examples=400, deadline=None)
def test_no_match_is_kept_from_its_pattern(parts):
    text = "".join(parts)
    for p in KNOWN:
        if re.search(p, text):
            assert pre.could_match(text, p), (p, text)


def test_what_is_known_of_patterns():
    assert pre.needed(r"^a (INFO|WARN): \[\d+\] x?yz") == (False, (frozenset(["INFO", "WARN"]), frozenset([": ["])))
    assert pre.needed(r"(?i)Union\s+SELECT") == (True, (frozenset(["select"]), frozenset(["union"])))
    assert pre.needed(r"a?|b*")[1] == () and pre.needed(r"\x{AC}")[1] == ()
    assert pre.opening(r"^(?:^\d{4}-)") == ("0", "9") and pre.opening(r"^[A-Z]x") == ("A", "Z") and pre.opening("^# T") == ("#", "#")
    assert pre.opening(r"^a|b") is None and pre.opening("(?i)^a") is None and pre.opening("a") is None


def test_few_patterns_run_on_a_line(spark):
    lines = [r.line.strip() for r in raw_lines(spark, "/root/testdata/sf0.001").collect()]
    runs = [sum(pre.could_match(x, p) for p in PATTERNS[: sum(k in ("re", "find") for _, k, _ in LINE_TESTS)]) for x in lines]
    assert statistics.median(runs) <= 12


def test_types_against_patterns_alone(spark):
    r = random.Random(4)
    lines = [x.line for x in raw_lines(spark, "/root/testdata/sf0.001").limit(150).collect()]
    lines += ["".join(r.choice(PIECES) for _ in range(r.randint(1, 7))) for _ in range(300)]
    lines += ["12", "-1.5e3", "12 x", "true", "truex", '"a"', '{"a": 1}', "[1, 2]", "[1, 2", '["x"]', '{"log": 1, "stream": 2, "time": 3}', "a,b,c,Security,x,y,z,1,2", "2024-01-02", "01", ""]
    frame = spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "source string, line_no long, line string")
    got = {row.line_no: row.types for row in ps.matching_types(frame.withColumn("line", ps.strip(frame["line"]))).collect()}
    kinds = [(n, start_anchored(a) if k == "re" else a) for n, k, a in LINE_TESTS if k in ("re", "find")]
    stripped = frame.withColumn("line", ps.strip(frame["line"]))
    plain = stripped.select("line_no", *[stripped["line"].rlike(p).alias(f"p{k}") for k, (_, p) in enumerate(kinds)])
    names = {n for n, _ in kinds}
    for row in plain.collect():
        assert [n for k, (n, _) in enumerate(kinds) if row[f"p{k}"]] == [n for n in got[row.line_no] if n in names], lines[row.line_no]
    first = {row.line_no: row.line_type for row in ps.line_type(frame).collect()}
    assert all(first[k] == (got[k] or ["Custom / Raw"])[0] for k in got)
    json = {lines[k] for k, t in got.items() if "MongoDB Server" in t}
    assert {"12", "-1.5e3", "true", '"a"', '{"a": 1}', "[1, 2]", '["x"]'} <= json and not {"12 x", "truex", "[1, 2", "2024-01-02", "01"} & json


def test_first_characters_of_a_match():
    assert pre.first_chars(r"^\d{4}-x") == set("0123456789") and pre.first_chars(r"^(?:[A-C]x|-?\d)") == set("ABC-0123456789")
    assert pre.first_chars(r"(?i)^(?:ab|_)") == set("aA_") and pre.first_chars(r"^a*") is None and pre.first_chars("ab") is None
    for open_start in (r"^\S+ -", r"^(.*?)x", r"^[^a]", r"^(?!a)b", r"^(?:a|.)"):
        assert pre.first_chars(open_start) is None


def test_types_by_first_character_are_the_first_of_all_types(spark):
    """A line meets the tests of its first character only; it gets the type that all tests in order give it."""
    known = [
        "", "-5", "12", "true", "null", '"x"', '{"a": 1}', "[1, 2]", "{broken", "# Time: 1", "* Running on x", "(1)01/02/2024 10:00:00 - u (1.2.3.4)> 230 ok",
        "jan 01 10:00:00 fw kernel: IPTABLES-DROP: IN=a OUT= SRC=1.2.3.4 DST=1.2.3.5 PROTO=TCP", "ACTION_ID=x NAME=y", "Ünï - - [x] \"y\" 200 5", "é",
        "GET /a 200 5ms", "type=USER msg=audit(1.2:3): x", "1.2.3.4 - - [01/Jan/2024:10:00:00 +0000] \"GET / HTTP/1.1\" 200 5", "**Alert 1.2 - a b - Rule: 1 - Level: 2 - c",
        "date=2024-01-01 time=10:00:00 action=deny srcip=1.2.3.4 dstip=1.2.3.5", "x Server Error: 1, Severity: 2, State: 3", "_ /a 1 2ms",
        "2024-01-01 10:00:00.000 UTC [5] u@shop ERROR: x", "  Jan  1 10:00:00 h systemd[1]: x  ", None,
    ]
    lines = spark.createDataFrame([(s,) for s in known], "line STRING").unionByName(raw_lines(spark, "/root/testdata/sf0.001").select("line"))
    alone = ps.matching_types(lines.withColumn("line", ps.strip(F.col("line"))))
    want = {(r["line"] or "").strip(): r["types"][0] if r["types"] else RAW for r in alone.collect()}
    got = {(r["line"] or "").strip(): r["line_type"] for r in ps.line_type(lines).collect()}
    assert got == want and len(set(got.values())) > 15
    few = sum(1 for _, kind, arg in LINE_TESTS if (can := ps.first_chars(kind, arg)) is None or can & set("abcdefghijklmnopqrstuvwxyz"))
    assert few < len(LINE_TESTS) / 2


def test_groups_behind_plain_strings(spark):
    """With the lower-case text a pattern gives what it gives alone, also for letters in either case and no text."""
    lines = ["Failed FROM 1.2.3.4 Port 22", "for Ann from b", "USER: x", "x [01/Feb/2024:10:00:00 +0100]", "x [01/Feb/2024:10:00:00]", "İ from 1.2.3.4", "", None]
    df = spark.createDataFrame([(s,) for s in lines], "line STRING").withColumn("low", F.lower("line"))
    line, low, fields = F.col("line"), F.col("low"), F.create_map(F.lit("a"), F.lit("b"))
    pairs = [(f(line, fields), f(line, fields, low)) for f in (nz.source_ip_col, nz.user_name_col, nz.action_col, nz.outcome_col, nz.source_struct)]
    pairs += [(nz.severity_col(line), nz.severity_col(line, low)), (nz.tags_col(F.lit("t"), line), nz.tags_col(F.lit("t"), line, low))]
    rows = df.select(*[c.alias(f"{k}{i}") for i, pair in enumerate(pairs) for k, c in zip("ab", pair)], nz.line_ts(line, fields, 2024).cast("string").alias("ts")).collect()
    for r in rows:
        assert all(r[f"a{i}"] == r[f"b{i}"] for i in range(len(pairs)))
    assert [r["a0"] for r in rows] == ["1.2.3.4", None, None, None, None, "1.2.3.4", None, None]
    assert [r["a1"] for r in rows][:3] == [None, "Ann", "x"]
    assert [r["ts"] for r in rows][3:5] == ["2024-02-01 09:00:00", "2024-02-01 10:00:00"] and not any(r["ts"] for r in rows[:3] + rows[5:])
