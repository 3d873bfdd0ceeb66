"""Conversation structure repair: the cheapest edits that make turns alternate, over a grammar of role and fault sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import shared_folder, table, total, written
from tracehound.llm.skew import joined, rows_at_once

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What the turns so far end with. Only the first turn of all may be a system's; a conversation may end empty or after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Symbol of a row: initial of its role (x: another), in capitals if its text is truncated, a digit if it must go.
ROLES = "suax"
SYMBOLS = ROLES + ROLES.upper() + "0123"
#: Rows of a block are BLOCK at most; blocks are combined FAN at a time.
BLOCK_BITS, FAN_BITS = 10, 6
#: Symbols whose sequences share a grammar.
SYMBOLS_AT_ONCE = 300_000

Entry = tuple  # (cost, rope): a rope is a string or a pair of ropes
Matrix = list  # 16 entries or None, by state before and state after


# Costs and audits


def flat(rope) -> str:
    out, stack = [], [rope]
    while stack:
        r = stack.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            stack += (r[1], r[0])
    return "".join(out)


def better(x: Entry | None, y: Entry | None) -> Entry | None:
    """The cheaper entry, of equal ones that with the smaller audit. Neither audit is a prefix of the other: the rest would be inserts, which cost."""
    if x is None or y is None:
        return x or y
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return x if flat(x[1]) <= flat(y[1]) else y


def inserts(state: int) -> Iterator[tuple[int, int]]:
    """States that inserted turns lead to, with their number. More than two only lead round."""
    for n in range(3):
        if n < 2 or state in (START, SYSTEM):
            yield n, state
        state = NEXT[state]


def of_symbol(symbol: str) -> Matrix:
    """Inserts before a row, then its own edit."""
    kind = SYMBOLS.index(symbol)
    role, extra, must_go = ROLES[kind % 4], TRUNCATED if 4 <= kind < 8 else 0, kind >= 8
    out: Matrix = [None] * 16

    def offer(i: int, k: int, cost: int, audit: str) -> None:
        out[4 * i + k] = better(out[4 * i + k], (cost, audit))

    for i in STATES:
        for n, state in inserts(i):
            cost, audit = INSERT * n, "I" * n
            offer(i, state, cost + DELETE, audit + "D")
            if not must_go:
                after = NEXT[state]
                offer(i, after, cost + extra + REROLE, audit + "R")
                if role == "sua"[after - 1]:
                    offer(i, after, cost + extra, audit + "K")
                if role == "s" and state == START:
                    offer(i, SYSTEM, cost + extra, audit + "K")
    return out


def product(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n: least cost over the state between, audits put together."""
    out: Matrix = [None] * 16
    for i in STATES:
        for j in STATES:
            if (x := m[4 * i + j]) is not None:
                for k in STATES:
                    if (y := n[4 * j + k]) is not None:
                        best = out[4 * i + k]
                        if best is None or x[0] + y[0] <= best[0]:
                            out[4 * i + k] = better(best, (x[0] + y[0], (x[1], y[1])))
    return out


def ended(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation: from the start to an allowed end, with inserts behind the last row."""
    best = None
    for k in STATES:
        if (x := m[k]) is not None:
            n = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[k]
            best = better(best, (x[0] + INSERT * n, (x[1], "I" * n)))
    return best[0], flat(best[1])


# Grammar


def grammar(sequences: list[str]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Re-Pair: rules (two symbols each, numbered from len(SYMBOLS) on) and the sequences written with them.

    The most frequent neighbours become a rule, then the next, until no pair stands twice. Frequent pairs that cannot
    overlap each other, because no symbol is the left of one and the right of another, are replaced in one go.
    """
    number = {s: k for k, s in enumerate(SYMBOLS)}
    text = np.concatenate([np.array([number[c] for c in s] + [-1], np.int64) for s in sequences]) if sequences else np.empty(0, np.int64)
    rules: list[tuple[int, int]] = []
    while len(text) > 1:
        key = np.where((text[:-1] >= 0) & (text[1:] >= 0), text[:-1] * (1 << 31) + text[1:], -1)
        found, times = np.unique(key[key >= 0], return_counts=True)
        if not len(found) or times.max() < 2:
            break
        order = np.argsort(-times, kind="stable")
        order = order[times[order] * 2 > times[order[0]]]
        lefts, rights, chosen = set(), set(), []
        for o in order[times[order] >= 2]:
            x, y = divmod(int(found[o]), 1 << 31)
            if x == y and not chosen:
                chosen.append((int(found[o]), x, y))
                break
            if x != y and x not in rights and y not in lefts:
                lefts.add(x)
                rights.add(y)
                chosen.append((int(found[o]), x, y))
        chosen.sort()
        keys = np.array([c[0] for c in chosen])
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        if chosen[0][1] == chosen[0][2]:  # runs of one symbol: every other place
            start = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            places = np.flatnonzero(hit)
            hit[places] = (places - start[np.searchsorted(start, places, "right") - 1]) % 2 == 0
            if np.count_nonzero(hit) < 2:
                break
        places = np.flatnonzero(hit)
        text[places] = len(SYMBOLS) + len(rules) + at[places]
        text = np.delete(text, places + 1)
        rules += [c[1:] for c in chosen]
    ends = np.flatnonzero(text < 0)
    return rules, [w[:-1] for w in np.split(text, ends + 1)[:-1]]


def matrices(sequences: list[str]) -> list[Matrix]:
    """The transfer matrix of each sequence: one product a rule, bottom up, then a product for each symbol that is left."""
    rules, words = grammar(sequences)
    made = [of_symbol(s) for s in SYMBOLS]
    for x, y in rules:
        made.append(product(made[x], made[y]))
    out = []
    for w in words:
        m = made[w[0]]
        for symbol in w[1:]:
            m = product(m, made[symbol])
        out.append(m)
    return out


def joints(sequence: str) -> tuple[str, str, int]:
    """First and last initial, and how many neighbours are not system-user, user-assistant or assistant-user."""
    initials = "".join(ROLES[SYMBOLS.index(c) % 4] for c in sequence)
    return initials[0], initials[-1], sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


NODE = "costs array<int>, audits array<string>, first string, last string, illegal long"


def node(m: Matrix, first: str, last: str, illegal: int) -> dict:
    return {"costs": [None if x is None else x[0] for x in m], "audits": [None if x is None else flat(x[1]) for x in m], "first": first, "last": last, "illegal": illegal}


def solved(sequences: DataFrame) -> DataFrame:
    """(seq) as (seq, cost, audit, and the node of the sequence as a part of a longer one). Sequences of a batch share rules."""

    def run(batches):
        for batch in batches:
            every = batch.column("seq").to_pylist()
            size, part = 0, []
            for k, s in enumerate(every):
                part.append(s)
                size += len(s)
                if size > SYMBOLS_AT_ONCE or k == len(every) - 1:
                    rows = []
                    for x, m in zip(part, matrices(part)):
                        cost, audit = ended(m)
                        rows.append({"seq": x, "cost": cost, "audit": audit} | node(m, *joints(x)))
                    yield pa.RecordBatch.from_pylist(rows, SOLVED)
                    size, part = 0, []

    return sequences.mapInArrow(run, "seq string, cost long, audit string, " + NODE)


SOLVED = pa.schema([("seq", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("costs", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())])


def folded(nodes: DataFrame, folder: str) -> DataFrame:
    """(conv, block, node) as (conv, cost, audit, illegal): neighbouring blocks are combined FAN at a time, round by round.

    Blocks are numbered in the order of their rows, so a group is a range of block numbers: a shift of the number. No
    task gets more than 64 nodes of a conversation at once.
    """

    def fold(frame):
        import pandas as pd

        frame = frame.sort_values("block")
        m, first, last, illegal = None, None, None, 0
        for r in frame.itertuples():
            n = [None if a is None else (int(c), a) for c, a in zip(r.costs, r.audits)]
            if m is None:
                m, first, illegal = n, r.first, r.illegal
            else:
                m, illegal = product(m, n), illegal + r.illegal + (last + r.first not in ("su", "ua", "au"))
                m = [None if x is None else (x[0], flat(x[1])) for x in m]
            last = r.last
        cost, audit = ended(m)
        return pd.DataFrame([{"conv": frame["conv"].iloc[0], "block": frame["up"].iloc[0], "cost": cost, "audit": audit} | node(m, first, last, illegal)])

    kind = nodes.schema["conv"].dataType.simpleString()
    rounds = 0
    while True:
        up = nodes.withColumn("up", F.shiftright("block", FAN_BITS))
        made = up.groupBy("conv", "up").applyInPandas(fold, f"conv {kind}, block long, cost long, audit string, {NODE}")
        made = written(made, folder, f"fold{rounds}")
        n, convs = total(made.groupBy("conv").count(), F.sum("count"), F.count("*"))
        if n is None or n == convs:
            return made.select("conv", "cost", "audit", "illegal")
        nodes, rounds = made.drop("cost", "audit"), rounds + 1


# Rows


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with seeded faults, by crc32 of `conv_id:turn` modulo 20; nulls count as one space.

    0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = c.withColumn("_kind", F.crc32(key) % 20).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return c.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def prepared(rows: DataFrame) -> DataFrame:
    """Rows with the key that orders those of one turn; null roles and texts are one space."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def marked(rows: DataFrame, folder: str) -> DataFrame:
    """Prepared rows as (conv, turn, at, fault, symbol): `at` rises along every conversation; fault is blank, duplicate, truncated or null.

    Rows are put in order by ranges of (conversation, turn), so a conversation of any length is spread over tasks.
    Repeated role and text is told by the least `at` of its group, which is summed in the tasks first.
    """
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    slim = rows.select("conv", "turn", "role", "digest", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv", "turn", "role", "digest", "tie"]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, folder, "placed")
    twice = placed.where("NOT blank").groupBy(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = placed.where("NOT blank").join(twice, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))).where("at > first")
    out = placed.join(again.select("at", F.lit(True).alias("again")), "at", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(fault.isin("blank", "duplicate"), F.translate(role, ROLES, "0123")).when(fault == "truncated", F.upper(role)).otherwise(role)
    return written(out.select("conv", "turn", "at", fault.alias("fault"), symbol.alias("symbol")), folder, "marked")


def audits(symbols: DataFrame, folder: str) -> DataFrame:
    """(conv, at, symbol) as (conv, cost, audit, illegal). Equal sequences are solved once, whatever conversations hold them."""
    block = F.shiftright("at", BLOCK_BITS)
    in_order = F.array_sort(F.collect_list(F.struct("at", "symbol")))
    words = symbols.groupBy("conv", block.alias("block")).agg(F.array_join(in_order["symbol"], "").alias("seq"))
    words = written(words, folder, "words")
    sizes = written(words.groupBy("seq").agg(F.count("*").alias("n")), folder, "sequences")
    solutions = written(solved(sizes.select("seq").repartitionByRange("seq")), folder, "solved")
    blocks = words.groupBy("conv").agg(F.count("*").alias("blocks"), F.min("seq").alias("seq"))
    short = joined(blocks.where("blocks = 1").select("conv", "seq"), solutions.select("seq", "cost", "audit", "illegal"), "seq", sizes)
    long = words.join(blocks.where("blocks > 1").select(F.col("conv").alias("_c")), F.col("conv").eqNullSafe(F.col("_c")), "left_semi")
    nodes = written(joined(long, solutions.drop("cost", "audit"), "seq", sizes).drop("seq"), folder, "nodes")
    return written(short.drop("seq").unionByName(folded(nodes, folder)), folder, "audits")


def played(batches) -> Iterator[tuple]:
    """Conversations of a sorted partition (its audit first, then its rows) as events: ('open', conv), ('line', role, text) and ('close', conv)."""
    name = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
    conv, edits, at, state, open_ = None, "", 0, START, False

    def inserted(at: int, state: int):
        while at < len(edits) and edits[at] == "I":
            state = NEXT[state]
            yield at + 1, state, ("line", name[state], "")
            at += 1

    for batch in batches:
        for c, is_row, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "is_row", "role", "text"))):
            if not is_row:
                if open_:
                    for at, state, line in inserted(at, state):
                        yield line
                    yield "close", conv
                conv, edits, at, state, open_ = c, text, 0, START, True
                yield "open", conv
                continue
            for at, state, line in inserted(at, state):
                yield line
            edit, at = edits[at], at + 1
            if edit == "K":
                state = SYSTEM if role.startswith("s") else NEXT[state]
                yield "line", role, text
            elif edit == "R":
                state = NEXT[state]
                yield "line", name[state], text
    if open_:
        for at, state, line in inserted(at, state):
            yield line
        yield "close", conv


def streamed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, all in one partition; memory is bounded, as rows are only passed along."""
    head = edits.select("conv", F.lit(False).alias("is_row"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    body = rows.select("conv", F.lit(True).alias("is_row"), "turn", "role", "text", "digest")
    return head.unionByName(body).repartition("conv").sortWithinPartitions("conv", "is_row", "turn", "role", "digest").select("conv", "is_row", "role", "text")


def hashed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of the repaired `role:text` lines, fed line by line."""
    stream = streamed(rows, edits)
    kind = stream.schema["conv"].dataType.simpleString()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(stream_type)
        convs, sums, digest, lines = [], [], None, 0
        for event in played(batches):
            if event[0] == "open":
                digest, lines = hashlib.sha256(), 0
            elif event[0] == "line":
                digest.update(("\n" if lines else "").encode() + f"{event[1]}:{event[2]}".encode())
                lines += 1
            else:
                convs.append(event[1])
                sums.append(digest.hexdigest())
                if len(convs) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(convs, arrow), pa.array(sums, pa.string())], ["conv", "repaired_sha256"])
                    convs, sums = [], []
        yield pa.RecordBatch.from_arrays([pa.array(convs, arrow), pa.array(sums, pa.string())], ["conv", "repaired_sha256"])

    stream_type = stream.schema["conv"].dataType
    return stream.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The conversations (conv_id, turn, role, text) as the cheapest edits leave them: conv_id, line (from 0), role, text. Faults as in `repaired`."""
    folder = shared_folder(conversations.sparkSession)
    rows = prepared(conversations)
    stream = streamed(rows, audits(marked(rows, folder).select("conv", "at", "symbol"), folder))
    kind, stream_type = stream.schema["conv"].dataType.simpleString(), stream.schema["conv"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(stream_type), pa.int64(), pa.string(), pa.string()]
        conv, line, held, size = None, 0, [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held) if held else [()] * 4, types)], ["conv_id", "line", "role", "text"])

        for event in played(batches):
            if event[0] == "open":
                conv, line = event[1], 0
            elif event[0] == "line":
                held.append((conv, line, event[1], event[2]))
                line, size = line + 1, size + len(event[2])
                if size > 4_000_000 or len(held) >= 10_000:
                    yield batch()
                    held, size = [], 0
        yield batch()

    return stream.mapInArrow(run, f"conv_id {kind}, line long, role string, text string")


def repaired(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text): faults, and the cheapest edits that mend them.

    conv_id, gaps (turns missing between the first and the last), blank, duplicate, truncated (rows by their first
    fault: no word, role and text seen earlier, no sentence end), illegal (neighbouring roles that are not system-user,
    user-assistant or assistant-user), cost, audit (an initial for each edit, in order: Keep 0, Rerole 3, Delete 4 and
    a must for blank and duplicate rows, Insert 3; a truncated row that stays adds 3), repaired_sha256 of the repaired
    `role:text` lines. Repaired roles are an optional system turn, then user and assistant in turn, or nothing; of
    audits that cost the same the smallest counts. ids: conv_id of conversations that are returned even without rows.

    Rows of one turn go by role, then by the text's digest; null turns come first and count in no gap. Null roles and texts
    are one space; a null conv_id is a conversation of its own. Empty and very long texts are rows like others, repeated
    rows duplicates; other columns are left out, whatever their names. An empty table gives none. An audit is one cell, a
    letter an edit; the digest of a conversation is one sequence by nature, so a task streams it in bounded memory. All
    else is done by blocks of rows.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    rows = prepared(rows)
    faults = marked(rows, folder)
    with rows_at_once(spark, 2000):
        edits = audits(faults.select("conv", "at", "symbol"), folder)
        sums = written(hashed(rows, edits), folder, "sums")
    counts = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    stats = faults.groupBy("conv").agg(span.alias("gaps"), *counts)
    every = stats.select("conv") if ids is None else ids.select(F.col("conv_id").alias("conv")).distinct()
    out = every
    for part in (stats, edits, sums):
        part = part.withColumnRenamed("conv", "_c")
        out = out.join(part, F.col("conv").eqNullSafe(F.col("_c")), "left").drop("_c")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repaired(damaged(conversations), ids=conversations)


SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, len(s) + 1), lambda p: [ascii(s[p])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d),
f AS (SELECT *, substr(role, 1, 1) AS i, CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r),
g AS (SELECT *, CASE WHEN n > 1 AND lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad FROM f),
ins(a, b, c, w) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
act(i, a, b, c, w) AS (VALUES ('', 0, 0, 4, 'D'), ('', 1, 1, 4, 'D'), ('', 2, 2, 4, 'D'), ('', 3, 3, 4, 'D'), ('', 0, 2, 3, 'R'), ('', 1, 2, 3, 'R'), ('', 3, 2, 3, 'R'), ('', 2, 3, 3, 'R'),
        ('s', 0, 1, 0, 'K'), ('u', 0, 2, 0, 'K'), ('u', 1, 2, 0, 'K'), ('u', 3, 2, 0, 'K'), ('a', 2, 3, 0, 'K')),
e AS (SELECT conv_id, n, ins.a AS a, act.b AS b, ins.c + act.c + CASE WHEN fault = 'truncated' AND act.w <> 'D' THEN 3 ELSE 0 END AS c, ins.w || act.w AS w
        FROM g JOIN act ON (act.i = '' OR act.i = g.i) AND (act.w = 'D' OR g.fault NOT IN ('blank', 'duplicate')) JOIN ins ON ins.b = act.a),
z AS (SELECT conv_id, 0::BIGINT AS n, 0 AS st, struct_pack(c := 0::BIGINT, w := '') AS v FROM (SELECT DISTINCT conv_id FROM g)
        UNION ALL SELECT z.conv_id, z.n + 1, e.b, min(struct_pack(c := z.v.c + e.c, w := z.v.w || e.w)) FROM z JOIN e ON e.conv_id IS NOT DISTINCT FROM z.conv_id AND e.n = z.n + 1 AND e.a = z.st GROUP BY z.conv_id, z.n, e.b),
m AS (SELECT conv_id, max(n) AS n, sum(bad) AS illegal, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM g GROUP BY conv_id),
b AS (SELECT m.conv_id, min(struct_pack(c := z.v.c + CASE st WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, w := z.v.w || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END)) AS v FROM m JOIN z ON z.conv_id IS NOT DISTINCT FROM m.conv_id AND z.n = m.n GROUP BY m.conv_id),
p AS (SELECT conv_id, unnest(range(1, len(v.w) + 1)) AS p, v.w AS w FROM b),
q AS (SELECT conv_id, p, w[p] AS x, p - len(replace(w[1:p], 'I', '')) AS made, len(replace(w[1:p], 'I', '')) AS n, len(replace(w[1:p], 'D', '')) AS line FROM p),
o AS (SELECT q.*, g.role, g.text, g.i, max(CASE WHEN q.line = 1 AND x = 'K' AND g.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS sys FROM q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id AND g.n = q.n WHERE x <> 'D'),
t AS (SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (line - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS repaired_sha256 FROM o GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
        coalesce(b.v.c, 0)::BIGINT AS cost, coalesce(b.v.w, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
