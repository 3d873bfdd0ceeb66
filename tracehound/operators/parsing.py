"""From lines to entries: typing, grouping, field extraction, envelope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.functions import normalize as nz
from tracehound.functions import prefilter as pre
from tracehound.functions.normalize import bind, found
from tracehound.operators.intervals import previous_value, running_last
from tracehound.rules import dims
from tracehound.rules.formats import BLOCK_OPENINGS, CONTINUATIONS, ENTRY_OPENINGS, LINE_TESTS, RAW, TYPE_NAMES, start_anchored
from tracehound.rules.specs import JSON_SPECS, KEY_VALUE_TYPES, MONGO_SEVERITY, PATTERN_SPECS
from tracehound.schema import computed

SPACE = " \t\r\n\f\x0b"
SLICE_LINES = 200_000


def strip(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


# --- typing ---------------------------------------------------------------------------------------------


# First and last character of a JSON text, and a JSON number; lines that only begin like JSON are not parsed.
JSON_ENDS = ["[]", "{}", '""']
JSON_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def _is_json(line: Column) -> Column:
    """Whether the line is one JSON value."""
    t = strip(line)
    ends = reduce(lambda a, b: a | b, [F.startswith(t, F.lit(x)) & F.endswith(t, F.lit(y)) for x, y in JSON_ENDS])
    return F.coalesce((ends | t.isin("true", "false", "null") | t.rlike(JSON_NUMBER)) & F.try_parse_json(line).isNotNull(), F.lit(False))


def line_test(kind: str, arg) -> str:
    """One row of the format table as an SQL condition on a stripped line."""
    line = pre.TEXT
    if kind == "re":
        return pre.matches(start_anchored(arg), line, pre.LOWERED)
    if kind == "find":
        return pre.matches(arg, line, pre.LOWERED)
    if kind == "has":
        return "(" + " OR ".join(f"contains({line}, {pre.quoted(w)})" for w in arg) + ")"
    if kind == "json":
        ends = " OR ".join(f"startswith({line}, {pre.quoted(x)}) AND endswith({line}, {pre.quoted(y)})" for x, y in JSON_ENDS)
        number = f"{line} >= '-' AND {line} < ':' AND {line} RLIKE {pre.quoted(JSON_NUMBER)}"
        return f"coalesce(({ends} OR {line} IN ('true', 'false', 'null') OR {number}) AND try_parse_json({line}) IS NOT NULL, false)"
    if kind == "array":
        return f"coalesce(startswith({line}, '[') AND json_array_length({line}) > 0, false)"
    if kind in ("keys", "keys_find"):
        names = arg if kind == "keys" else arg[0]
        have = [f"contains({line}, {pre.quoted(k)})" for k in names] + [f"array_contains(json_object_keys({line}), {pre.quoted(k)})" for k in names]
        if kind == "keys_find":
            have.append(f"{line} RLIKE {pre.quoted(arg[1])}")
        return f"coalesce(startswith({line}, '{{') AND {' AND '.join(have)}, false)"
    if kind == "cell":
        header, width, at, value, absent = arg
        row = f"contains({line}, {pre.quoted(value)}) AND size(split({line}, ',')) >= {width} AND get(split({line}, ','), {at}) = {pre.quoted(value)} AND NOT contains({line}, {pre.quoted(absent)})"
        return f"(startswith({line}, {pre.quoted(header)}) OR coalesce({row}, false))"
    raise ValueError(kind)


#: Lines are told apart by their first character, so that they meet only the tests which such a line can pass.
FIRST_RANGES = ["09", "AZ", "az", "[[", "{{", "##"]


def first_chars(kind: str, arg) -> frozenset | None:
    """Characters that a line taken by a row of the format table can begin with; None if it may be any."""
    if kind == "re":
        return pre.first_chars(start_anchored(arg))
    return {"json": frozenset('[{"-0123456789tfn'), "array": frozenset("["), "keys": frozenset("{"), "keys_find": frozenset("{")}.get(kind)


def _first_type(tests) -> str:
    return "CASE " + " ".join(f"WHEN {line_test(kind, arg)} THEN {pre.quoted(name)}" for name, kind, arg in tests) + f" ELSE {pre.quoted(RAW)} END"


def line_type(df: DataFrame) -> DataFrame:
    """First type of the format table that takes the line, as ``line_type``."""
    sides = []
    for lo, hi in FIRST_RANGES:
        here = {chr(c) for c in range(ord(lo), ord(hi) + 1)}
        tests = [t for t in LINE_TESTS if (can := first_chars(*t[1:])) is None or can & here]
        sides.append(f"WHEN {pre.TEXT} >= {pre.quoted(lo)} AND {pre.TEXT} < {pre.quoted(chr(ord(hi) + 1))} THEN {_first_type(tests)}")
    first = f"CASE {' '.join(sides)} ELSE {_first_type(LINE_TESTS)} END"
    bound, kind = pre.decided(df, strip(F.col("line")), first)
    return computed(bound, line_type=kind).drop("_t")


def matching_types(df: DataFrame) -> DataFrame:
    """All types that take the line, in priority order, as ``types``."""
    every = ", ".join(f"CASE WHEN {line_test(kind, arg)} THEN {pre.quoted(name)} END" for name, kind, arg in LINE_TESTS)
    bound, types = pre.decided(df, F.col("line"), f"array_compact(array({every}))")
    return computed(bound, types=types).drop("_t")


def detect_source_type(df: DataFrame, voters: int, proposers: int) -> DataFrame:
    """Type of each source by the votes of its first ``voters`` non-blank lines.

    The first ``proposers`` of them give 3 votes to every type that takes them. Later lines give 3 votes to the first of those
    candidates that takes them, else 1 to raw. Highest score wins, ties by priority, below 3 it is raw.
    """
    lines = df.withColumn("line", strip(F.col("line"))).where("line <> ''")
    w = Window.partitionBy("source").orderBy("line_no")
    head = matching_types(lines.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= voters)).select("source", "rn", "types")
    early = head.where(F.col("rn") <= proposers)
    # at most one name per known type, however long the source is
    candidates = early.groupBy("source").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("cands"))
    late = head.where(F.col("rn") > proposers).join(candidates, "source").select(
        "source",
        F.coalesce(
            F.get(F.filter("types", lambda t: (F.size("cands") == 0) | F.array_contains(F.col("cands"), t)), F.lit(0)), F.lit(RAW)
        ).alias("type"),
    ).withColumn("votes", F.when(F.col("type") == RAW, 1).otherwise(3))
    votes = early.select("source", F.explode("types").alias("type"), F.lit(3).alias("votes")).unionByName(late)
    order = F.create_map(*[F.lit(x) for i, n in enumerate([*TYPE_NAMES, RAW]) for x in (n, i)])
    scored = votes.groupBy("source", "type").agg(F.sum("votes").alias("score"))
    best = scored.groupBy("source").agg(
        F.max(F.struct("score", (-F.element_at(order, F.col("type"))).alias("rank"), "type")).alias("b")
    )
    return head.select("source").distinct().join(best, "source", "left").select(
        "source", F.when(F.col("b.score") >= 3, F.col("b.type")).otherwise(RAW).alias("source_type"),
        F.coalesce(F.col("b.score"), F.lit(0)).alias("score"),
    )


# --- grouping -------------------------------------------------------------------------------------------


def _joined(df: DataFrame, sep: str = "\n") -> DataFrame:
    """Lines of one group put together in order; a group is one log entry."""
    g = df.groupBy("source", "opener").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return g.select(
        "source", F.col("opener").alias("line_no"), F.size("l").cast("bigint").alias("n_lines"),
        F.array_join(F.transform("l", lambda x: x["line"]), sep).alias("entry"),
    )


def is_entry_opening(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [line.rlike(p) for p in ENTRY_OPENINGS])


def is_continuation(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [line.rlike(p) for p in CONTINUATIONS])


def entry_lines(df: DataFrame, slice_lines: int = SLICE_LINES) -> DataFrame:
    """Each non-blank line with the number of the line that opened its entry (``opener``).

    An opening line starts an entry, a blank line ends it, the rest belongs to the entry before; the first
    line after a blank starts one in any case. No line is moved to its entry here, so a source that never
    opens an entry costs no more than any other.
    """
    marked = df.withColumn("blank", strip(F.col("line")) == "")
    before = previous_value(marked, ["source"], "line_no", "blank", slice_lines, "after_blank")
    starts = ~F.col("blank") & (is_entry_opening(F.col("line")) | F.coalesce("after_blank", F.lit(True)))
    held = running_last(before, ["source"], "line_no", F.when(starts, F.col("line_no")), slice_lines, "opener")
    return held.where("NOT blank").drop("blank", "after_blank")


def group_entries(df: DataFrame, slice_lines: int = SLICE_LINES) -> DataFrame:
    """Physical lines stitched into entries, one text per entry."""
    return _joined(entry_lines(df, slice_lines))


def group_blocks(df: DataFrame, kind: str, slice_lines: int = SLICE_LINES) -> DataFrame:
    """Blocks of a slow-query log, a database alert log or an audit log."""
    lines = df.withColumn("line", strip(F.col("line"))).where("line <> ''")
    opens = F.col("line").rlike(BLOCK_OPENINGS[kind])
    mark = F.when(opens, F.struct(F.col("line_no").alias("at"), F.lit(True).alias("open")))
    if kind == "mysql_slow":
        known = F.col("line").rlike(r"^# (User@Host|Query_time):")
        mark = mark.when(F.startswith("line", F.lit("#")) & ~known, F.struct(F.col("line_no").alias("at"), F.lit(False).alias("open")))
    held = running_last(lines, ["source"], "line_no", mark, slice_lines, "m").where("m.open")
    return _joined(held.withColumn("opener", F.col("m.at")))


def parse_blocks(df: DataFrame, kind: str) -> DataFrame:
    """Fields of a block; blocks without the fields that make them one are dropped."""
    b = F.col("entry")
    if kind == "mysql_slow":
        sql = F.filter(F.split(b, "\n"), lambda x: x.rlike("^(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)"))
        out = df.select(
            "source", "line_no", found(b, r"# Time:\s+(\S+)").alias("timestamp"),
            found(b, r"# User@Host:\s+(\w+)\[").alias("user"), found(b, r"# User@Host:\s+\w+\[\w+\]\s+@\s+(\S+)").alias("host"),
            found(b, r"# User@Host:[^\n]*\[([\d.]+)\]").alias("ip"), found(b, r"# Query_time:\s+([\d.]+)").try_cast("double").alias("query_time"),
            found(b, r"Rows_examined:\s+(\d+)").try_cast("bigint").alias("rows_examined"),
            F.nullif(F.array_join(F.transform(sql, lambda x: F.rtrim(x, F.lit(";"))), " "), F.lit("")).alias("sql"),
            F.lit("warning").alias("severity"),
        )
        return out.where("timestamp IS NOT NULL AND sql IS NOT NULL")
    if kind == "oracle_alert":
        message = strip(F.regexp_replace(b, r"^[^\n]*\n?", ""))
        upper = F.upper(message)
        out = df.where("n_lines >= 2").select(
            "source", "line_no", found(b, r"^([A-Za-z]{3}\s+[A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}\s+\d{4})").alias("timestamp"),
            found(message, r"ORA-(\d+):").alias("error_code"), found(message, r"ORA-\d+:\s*([^\n]+)").alias("error_message"),
            F.when(F.contains(message, F.lit("ORA-")) | F.contains(upper, F.lit("ERROR")), "error").when(F.contains(upper, F.lit("WARNING")), "warning").otherwise("info").alias("severity"),
            message.alias("message"),
        )
        return out.where("timestamp IS NOT NULL")
    out = df.select(
        "source", "line_no", found(b, r"TIMESTAMP:\s*(\S+)").alias("timestamp"), found(b, r"ACTION:\s*'([^']+)'").alias("action"),
        found(b, r"DATABASE USER:\s*'([^']+)'").alias("user"), F.lit("info").alias("severity"),
    )
    return out.where("timestamp IS NOT NULL AND action IS NOT NULL")


# --- field extraction -----------------------------------------------------------------------------------

SEP = "\u0001"


def groups_of(line: Column, pattern: str, n: int) -> Column:
    """All groups of the first match as one array, from one pass of the pattern."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    body = pattern[len(flag):]
    lead = "^" if body.startswith("^") else "^.*?"
    whole = f"(?s){flag}{lead}(?:{body.removeprefix('^')}).*$" if not body.endswith("$") else f"(?s){flag}{lead}(?:{body.removeprefix('^')[:-1]})$"
    return F.split(F.regexp_replace(line, whole, SEP.join(f"${i}" for i in range(1, n + 1))), SEP)


def _one_of(col: Column, pairs: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), col)


def _mail_fields(m: Column) -> Column:
    """Verdict, user and IP that a mail message implies."""
    text = F.element_at(m, F.lit("message"))
    verdict = (
        F.when(F.contains(text, F.lit("Passed CLEAN")), "allow,success")
        .when(F.contains(text, F.lit("disconnect from")), "disconnect,success").when(F.contains(text, F.lit("connect from")), "connect,success")
        .when(nz.has_any(text, ["authentication failed", "denied", "reject"]), "deny,failure").when(F.contains(text, F.lit("status=sent")), "deliver,success")
    )
    return with_defaults(m, {
        "source_ip": found(text, r"(\d{1,3}(?:\.\d{1,3}){3})"),
        "user": F.coalesce(found(text, r"(?i)(?:sasl_username|to|from|user)=<?([^>,\s]+)>?"), found(text, r"(?i)User\s+([^,\s\[\]]+)")),
        "action": F.substring_index(verdict, ",", 1), "outcome": F.coalesce(F.substring_index(verdict, ",", -1), F.lit("unknown")),
    })


def _pattern_fields(line: Column, pattern: str, names: list[str], opt: dict) -> Column:
    values = F.transform(groups_of(line, pattern, len(names)), lambda v: F.nullif(strip(v), F.lit("")))
    out = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), values)
    lower, dash, maps = opt.get("lower", []), opt.get("dash", []), opt.get("values", {})
    if lower or dash or maps:
        def tidy(k, v):
            r = None
            for n in lower:
                r = F.when(k == n, F.lower(v)) if r is None else r.when(k == n, F.lower(v))
            for n in dash:
                r = F.when(k == n, F.nullif(v, F.lit("-"))) if r is None else r.when(k == n, F.nullif(v, F.lit("-")))
            for n, pairs in maps.items():
                value = F.coalesce(_one_of(v, pairs), v)
                r = F.when(k == n, value) if r is None else r.when(k == n, value)
            return r.otherwise(v)
        out = F.transform_values(out, tidy)
    out = F.map_filter(out, lambda _, v: v.isNotNull())
    if "const" in opt:
        out = F.map_concat(out, F.create_map(*[F.lit(x) for kv in opt["const"].items() for x in kv]))
    if "join" in opt:
        name, pieces = opt["join"]
        out = bind(out, lambda m: F.map_concat(m, F.create_map(F.lit(name), F.concat_ws(" ", *[F.element_at(m, F.lit(p)) for p in pieces]))))
    if opt.get("mail"):
        out = bind(out, _mail_fields)
    return out


def _json_fields(line: Column, paths: list[tuple[str, str]]) -> Column:
    values = {name: F.get_json_object(line, path) for name, path in paths}
    if "severity_code" in values:
        mapping = F.create_map(*[F.lit(x) for kv in MONGO_SEVERITY.items() for x in kv])
        values["severity"] = F.coalesce(F.element_at(mapping, values["severity_code"]), F.lower(values["severity_code"]))
        del values["severity_code"]
    return F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(n) for n in values]), F.array(*values.values())), lambda _, v: v.isNotNull() & (v != "")
    )


def _key_value_fields(line: Column) -> Column:
    """key=value pairs; the statement takes the rest of the line."""
    statement = F.trim(found(line, r"statement=([\s\S]+)$"), F.lit(" '\""))
    head = F.regexp_replace(line, r"statement=[\s\S]+$", "")
    pair = r"(\w+)=('[^']*'|\"[^\"]*\"|\S+)"
    pairs = first_wins(
        F.transform(F.regexp_extract_all(head, F.lit(pair), F.lit(1)), F.lower),
        F.transform(F.regexp_extract_all(head, F.lit(pair), F.lit(2)), lambda x: F.trim(x, F.lit("'\""))),
    )
    return bind(pairs, lambda m: with_defaults(m, {
        "statement": statement, "timestamp": F.trim(found(line, r"event_time=([^=]+?)(?:\s+\w+=|$)")),
        "database": F.element_at(m, F.lit("database_name")), "user": F.element_at(m, F.lit("server_principal_name")),
    }))


def first_wins(keys: Column, values: Column) -> Column:
    """Map of two arrays; a repeated key keeps its first value."""
    def fold(z):
        pairs = F.arrays_zip(z["keys"].alias("k"), z["vals"].alias("v"))
        return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(z["keys"], x["k"]) == i + 1))

    return bind(F.struct(keys.alias("keys"), values.alias("vals")), fold)


def with_defaults(base: Column, extra: dict[str, Column]) -> Column:
    """Add fields that are missing from a map and have a value."""
    more = F.map_from_arrays(F.array(*[F.lit(k) for k in extra]), F.array(*extra.values()))
    return F.map_concat(base, F.map_filter(more, lambda k, v: v.isNotNull() & ~F.map_contains_key(base, k)))


def _spec_types() -> list[str]:
    seen: list[str] = []
    for types, *_ in [*PATTERN_SPECS, *JSON_SPECS]:
        seen += [t for t in types if t not in seen]
    return seen + KEY_VALUE_TYPES


def _spec_of(name: str, known: list[str]) -> str | None:
    """Exact type, else the first spec type whose name is part of it."""
    if name in known:
        return name
    return next((k for k in known if k.lower() in name.lower()), None)


def fields_col(line: Column, kind: Column) -> Column:
    """Fields of a line by its type; null where no spec takes the line."""
    known = _spec_types()
    takers: dict[str, list[str]] = {}
    for name in [*TYPE_NAMES, *[k for k in known if k not in TYPE_NAMES]]:
        spec = _spec_of(name, known)
        if spec:
            takers.setdefault(spec, []).append(name)
    out = None

    def add(cond: Column, value: Column):
        nonlocal out
        out = F.when(cond, value) if out is None else out.when(cond, value)

    for types, pattern, names, opt in PATTERN_SPECS:
        all_types = [n for t in types for n in takers.get(t, [])]
        add(kind.isin(all_types) & line.rlike(pattern), _pattern_fields(line, pattern, names, opt))
    for types, paths in JSON_SPECS:
        all_types = [n for t in types for n in takers.get(t, [])]
        add(kind.isin(all_types) & _is_json(line), _json_fields(line, paths))
    add(kind.isin([n for t in KEY_VALUE_TYPES for n in takers.get(t, [])]), _key_value_fields(line))
    return out


def extract_fields(df: DataFrame) -> DataFrame:
    """``fields`` by ``line_type``; null where nothing matches."""
    return computed(df, fields=fields_col(F.col("line"), F.col("line_type")))


# Pairs and single values of a line of no known format, and a string that all matches of the pattern hold.
PAIR_PATTERNS = [(r"(\w+)=([^,\s]+)",), (r"(\w+):\s*([^,\s]+)",), (r'"(\w+)":\s*"([^"]+)"',), (r'"(\w+)":\s*(\d+)',)]
PAIR_SIGNS = ["=", ":", '":', '":']


def generic_col(line: Column) -> Column:
    """Fields of any line: pairs (first key wins), IPs, user, status, method, service."""
    def all_of(group: int) -> Column:
        none = F.array().cast("array<string>")
        return F.concat(*[F.when(F.contains(line, F.lit(sign)), F.regexp_extract_all(line, F.lit(p), F.lit(group))).otherwise(none) for (p,), sign in zip(PAIR_PATTERNS, PAIR_SIGNS)])

    def extra(low: Column) -> dict[str, Column]:
        one = lambda pattern, group=1: found(line, pattern, group, low)
        service = one(r"(\w+)(?:\[\d+\])?:")
        return {
            "src_ip": F.coalesce(one(r"(?i)SRC[=_]" + nz.IPV4), one(r"(?i)from\s+" + nz.IPV4)),
            "dst_ip": F.coalesce(one(r"(?i)DST[=_]" + nz.IPV4), one(r"(?i)to\s+" + nz.IPV4)),
            "ip": one(nz.IPV4),
            "user": F.coalesce(*[one(r"(?i)user[=:\s]+(\w+)|account[=:\s]+(\w+)|for\s+(\S+)\s+from", i) for i in (1, 2, 3)]),
            "status": F.coalesce(*[one(r"\s(\d{3})\s|status[=:](\d+)", i) for i in (1, 2)]),
            "method": one(r"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)"),
            "service": F.when(~service.rlike(r"^\d+$"), service),
        }

    pairs = first_wins(F.transform(all_of(1), F.lower), all_of(2))
    return bind(F.struct(pairs.alias("pairs"), F.lower(line).alias("low")), lambda t: with_defaults(t["pairs"], extra(t["low"])))


def generic_fields(df: DataFrame) -> DataFrame:
    return computed(df, fields=generic_col(F.col("line")))


# First pattern per field of the dynamic fallback.
DYNAMIC = {
    "timestamp": [r"(?i)(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2})", r"(?i)(\d{2}/\w{3}/\d{4}:\d{2}:\d{2})", r"(?i)(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"],
    "ip": [r'(?i)src[_-]ip[=:]\s*"?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})', r'(?i)dst[_-]ip[=:]\s*"?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})', r"(?i)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"],
    "port": [r'(?i)src[_-]port[=:]\s*"?(\d{1,5})', r'(?i)dst[_-]port[=:]\s*"?(\d{1,5})', r"(?i)port[=:]\s*(\d{1,5})\b"],
    "user": [r'(?i)user[=:]\s*"?(\w[^"]*)"', r'(?i)username[=:]\s*"?(\w[^"]*)"'],
    "severity": [r"(?i)\b(debug|info|notice|warn|warning|error|err|fail|fatal|critical|alert)\b"],
}


def dynamic_fields(df: DataFrame) -> DataFrame:
    """Timestamp, IP, port, user and severity of a line, first pattern per field, with the severity scale."""
    cols = {f"dyn_{k}": F.coalesce(*[found(F.col("line"), p) for p in ps]) for k, ps in DYNAMIC.items()}
    word = F.lower(F.coalesce(*[found(F.col("line"), p) for p in DYNAMIC["severity"]]))
    cols["severity"] = F.when(word.isin("debug", "info", "warning", "error", "critical"), word).otherwise("unknown")
    return df.withColumns(cols)


def infer_structure(df: DataFrame, sample: int) -> DataFrame:
    """Per source: separator, columns and time position of the first line; field hits of the first lines."""
    w = Window.partitionBy("source").orderBy("line_no")
    head = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= sample)
    first = strip(F.col("line"))
    sep = None
    for s in (",", "\t", " | ", " "):
        cond = F.size(F.split(first, F.lit(s.replace("|", "\\|")))) >= 3
        sep = F.when(cond, F.lit(s)) if sep is None else sep.when(cond, F.lit(s))
    sep = sep.otherwise("unknown")
    cells = None
    for s in (",", "\t", " | ", " "):
        value = F.transform(F.split(first, F.lit(s.replace("|", "\\|"))), lambda c: F.trim(strip(c), F.lit("\"'")))
        cells = F.when(sep == s, value) if cells is None else cells.when(sep == s, value)
    cells = cells.otherwise(F.array().cast("array<string>"))
    stamped = F.transform(cells, lambda c: c.rlike(r"\d{4}-\d{2}-\d{2}|\d{2}/\w{3}/\d{4}"))
    flags = head.select(
        "source", "rn", sep.alias("separator"), cells.alias("columns"),
        (F.array_position(stamped, True).cast("int") - 1).alias("timestamp_index"), F.contains(first, F.lit("=")).alias("has_key_pairs"),
        F.regexp_count("line", F.lit(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")).alias("ips"),
        F.regexp_count("line", F.lit(r"(?i)user[=:]\s*['\"]?(\w+)")).alias("users"),
    )
    g = flags.groupBy("source").agg(
        F.min_by(F.struct("separator", "columns", "timestamp_index", "has_key_pairs"), "rn").alias("f"),
        F.sum("ips").alias("ip_hits"), F.sum("users").alias("user_hits"),
    )
    conf = lambda c: F.when(F.col(c) > 2, F.least(F.col(c) / F.lit(float(sample)), F.lit(1.0)))
    return g.select("source", "f.*", "ip_hits", "user_hits", conf("ip_hits").alias("ip_confidence"), conf("user_hits").alias("user_confidence"))


# --- envelope -------------------------------------------------------------------------------------------


def parse(df: DataFrame, default_year: int, force_type: str | None = None, per_source: bool = False, ingest: Column | None = None, votes: tuple[int, int] = (100, 10)) -> DataFrame:
    """Lines to typed lines with fields: forced type, else the source's type by vote, else the line's own.

    Fields come from the type's spec, else from the generic fallback; ``parsed`` says which.
    """
    lines = df.where(strip(F.col("line")) != "")
    if force_type:
        typed = lines.withColumn("line_type", F.lit(force_type))
    elif per_source:
        typed = lines.join(detect_source_type(df, *votes).select("source", F.col("source_type").alias("line_type")), "source")
    else:
        typed = line_type(lines)
    out = extract_fields(typed).withColumn("parsed", F.col("fields").isNotNull())
    out = computed(out, fields=F.coalesce("fields", generic_col(F.col("line"))))
    return computed(out, ts=nz.line_ts(F.col("line"), F.col("fields"), default_year, ingest))


def to_entries(df: DataFrame, message_cap: int | None = None) -> DataFrame:
    """Typed lines to the entry table; a message is the whole line unless a cap is asked for."""
    df = df.withColumn("_low", F.lower("line"))
    line, fields, low = F.col("line"), F.col("fields"), F.col("_low")
    kind = nz.log_type_of(F.col("line_type"))
    message = line if message_cap is None else F.substring(line, 1, message_cap)
    return df.select(
        nz.entry_id(F.col("source"), F.col("line_no"), line).alias("id"), F.col("source").alias("source_name"), "line_no", "ts",
        kind.alias("log_type"), nz.category_of(kind).alias("category"), nz.log_source_of(kind).alias("log_source"),
        nz.severity_col(line, low).alias("severity"), nz.source_struct(line, fields, low).alias("source"), nz.destination_struct(fields).alias("destination"),
        F.struct(nz.user_name_col(line, fields, low).alias("name"), F.lit(None).cast("string").alias("domain")).alias("user"),
        nz.action_col(line, fields, low).alias("action"), nz.outcome_col(line, fields, low).alias("outcome"), F.lit(None).cast("string").alias("country"),
        message.alias("message"), line.alias("raw_line"), fields.alias("fields"), nz.tags_col(kind, line, low).alias("tags"),
        F.lit(None).cast("string").alias("attack_type"), F.lit(None).cast("double").alias("attack_confidence"),
        F.lit(None).cast("array<string>").alias("mitre_tactics"), F.lit(None).cast("array<string>").alias("mitre_techniques"),
        F.lit(False).alias("is_anomaly"), F.lit(None).cast("double").alias("anomaly_score"),
    )


def parse_stats(df: DataFrame) -> DataFrame:
    """Total, parsed and failed lines with the rounded success rate."""
    return df.agg(F.count("*").alias("total_lines"), F.count_if(F.col("parsed")).alias("parsed_lines")).select(
        "total_lines", "parsed_lines", (F.col("total_lines") - F.col("parsed_lines")).alias("failed_lines"),
        F.when(F.col("total_lines") > 0, F.round(100.0 * F.col("parsed_lines") / F.col("total_lines"))).otherwise(0.0).alias("success_rate"),
    )


def merge_chunk_stats(chunks: DataFrame) -> DataFrame:
    """One result over chunks with (ok, total_lines, failed_lines): sums, recomputed rate, counts of chunks."""
    ok = F.col("ok")
    total, failed = F.sum(F.when(ok, F.col("total_lines"))), F.sum(F.when(ok, F.col("failed_lines")))
    return chunks.agg(
        total.alias("total_lines"), failed.alias("failed_lines"),
        F.round(F.try_divide((total - failed) * 100.0, total), 2).alias("success_rate"),
        F.count_if(ok).alias("ok_chunks"), F.count_if(~ok).alias("failed_chunks"),
    )


def type_dims(df: DataFrame) -> DataFrame:
    """Log type, category and log source of a line type."""
    kind = nz.log_type_of(F.col("line_type"))
    return df.withColumns({"log_type": kind, "log_source": nz.log_source_of(kind), "category": nz.category_of(kind)})


def winevent_action(df: DataFrame) -> DataFrame:
    """Action and outcome of a Windows event id; actions are known for the security channel only."""
    names = F.create_map(*[F.lit(x) for kv in dims.EVENT_ACTIONS.items() for x in kv])
    security = F.contains(F.lower("channel"), F.lit("security"))
    return df.withColumns({
        "action": F.when(security, F.coalesce(F.element_at(names, F.col("event_id")), F.lit("event"))).otherwise("event"),
        "outcome": F.when(F.col("event_id").isin(dims.EVENT_FAILURES), "failure").otherwise("success"),
    })


def enrich_country(df: DataFrame, geo: DataFrame, ip: str = "ip") -> DataFrame:
    """Country of an IP from a table of non-overlapping ranges (lo, hi, country): LOCAL for private ones, ``??`` if unknown.

    Only distinct IPs are looked up. Ranges are cut at /8 borders and each IP takes the last range that starts
    at or before it within its /8, so the lookup is one sort and neither side has to fit in memory.
    """
    wanted = df.select(F.col(ip).alias("_ip")).where(~nz.is_local_ip(F.col("_ip"))).distinct()
    asked = wanted.select("_ip", nz.ip_number(F.col("_ip")).alias("pos")).where("pos IS NOT NULL")
    starts = geo.select(
        "hi", "country", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))).alias("_b"), "lo",
    ).select(
        "_b", F.greatest("lo", F.shiftleft(F.col("_b"), 24)).alias("pos"), F.struct("hi", "country").alias("g"),
    )
    w = Window.partitionBy("_b").orderBy("pos", F.col("_ip").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = starts.withColumn("_ip", F.lit(None).cast("string")).unionByName(
        asked.withColumn("_b", F.shiftright("pos", 24)), allowMissingColumns=True
    )
    known = both.withColumn("hit", F.last("g", ignorenulls=True).over(w)).where("_ip IS NOT NULL AND pos <= hit.hi").select(
        "_ip", F.col("hit.country").alias("_country")
    )
    out = df.join(known, F.col(ip) == F.col("_ip"), "left")
    return out.withColumn(
        "country", F.when(nz.is_local_ip(F.col(ip)), "LOCAL").otherwise(F.coalesce("_country", F.lit("??")))
    ).drop("_ip", "_country")
