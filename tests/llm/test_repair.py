"""Conversation repair beside a plain search over all edits."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tracehound.llm import repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def plain(rows: list[tuple]) -> tuple:
    """rows: (turn, role, text) of one conversation. Every state keeps its cheapest edits, inserts closed over; also the repaired lines."""
    rows = sorted(((t, r or " " if r is None else r, x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def closed(best):
        best, more = dict(best), True
        while more:
            more = False
            for s, (c, w, lines) in list(best.items()):
                new = (c + 3, w + "I", (*lines, full[follow[s]] + ":"))
                if follow[s] not in best or new[:2] < best[follow[s]][:2]:
                    best[follow[s]], more = new, True
        return best

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for s, (c, w, lines) in closed(best).items():
            extra = 3 if fault == "truncated" else 0
            ways = [(s, c + 4, w + "D", lines)]
            if fault not in ("blank", "duplicate"):
                ways.append((follow[s], c + 3 + extra, w + "R", (*lines, f"{full[follow[s]]}:{text}")))
                if role[:1] == follow[s] or (role[:1] == "s" and s == ""):
                    ways.append((role[:1], c + extra, w + "K", (*lines, f"{role}:{text}")))
            for to, *way in ways:
                if to not in new or tuple(way[:2]) < new[to][:2]:
                    new[to] = tuple(way)
        best = new
    cost, audit, lines = min(v for s, v in closed(best).items() if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def hurt(conversations: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in conversations:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind:
            text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def wanted(rows: list[tuple], ids=None) -> dict:
    by = {c: [] for c in (ids if ids is not None else {r[0] for r in rows})}
    for conv, *row in rows:
        by[conv].append(tuple(row))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: plain(r) if r else none for c, r in by.items()}


def conversations(seed: int, n: int, longest: int = 9) -> list[tuple]:
    r = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "unfinished", "", " \t", "Well. ", "Done.\n", None]
    return [(c, t, r.choice(["system", "user", "assistant", "assistant", "user", "tool", None, ""]), r.choice(texts + [f"Text {r.random()}."] * 12)) for c in range(n) for t in range(r.randint(1, longest)) if r.random() < 0.95]


def as_dict(frame) -> dict:
    rows = frame.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS[1:]) for r in rows}
    assert len(out) == len(rows) and frame.columns == COLUMNS
    return out


def test_grammar_gives_the_sequences_back():
    r = random.Random(2)
    words = [*{"".join(r.choice("sua") for _ in range(r.randint(1, 60))) for _ in range(400)}, "u" * 501, "uuu", "uu", "ua" * 300]
    rules, out = repair.grammar(words)

    def spelt(symbol):
        return repair.SYMBOLS[symbol] if symbol < len(repair.SYMBOLS) else "".join(map(spelt, rules[symbol - len(repair.SYMBOLS)]))

    assert ["".join(map(spelt, w)) for w in out] == words
    assert sum(map(len, out)) + len(rules) < sum(map(len, words)) / 3


def test_matrices_are_the_same_however_sequences_are_cut():
    r = random.Random(3)
    words = ["".join(r.choice(repair.SYMBOLS) for _ in range(r.randint(2, 40))) for _ in range(200)]
    whole = repair.matrices(words)
    for w, m in zip(words, whole):
        k = r.randint(1, len(w) - 1)
        a, b = repair.matrices([w[:k], w[k:]])
        assert repair.ended(repair.product(a, b)) == repair.ended(m)


@pytest.mark.parametrize("bits", [(10, 6), (1, 1)])
def test_repair_against_plain(spark, bits, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(repair, "FAN_BITS", bits[1])
    rows = conversations(5, 150) + [(1000, t, "user" if t % 3 else "assistant", f"Line {t // 2}.") for t in range(300)]
    got = as_dict(repair.repaired(spark.createDataFrame(rows, TURNS).repartition(5)))
    assert got == wanted(rows)


def test_query_damages_rows_first(spark, tmp_path):
    rows = conversations(6, 120) + [(None, None, "user", "Hi."), (None, 1, None, "Ho."), (500, None, "assistant", None), (500, None, "user", "A."), (501, 3, "user", "Twice."), (501, 3, "user", "Twice.")]
    whole = spark.createDataFrame(rows, TURNS)
    whole.withColumns({n: F.lit("mine") for n in ("conv", "at", "seq", "block", "cost", "symbol")}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = as_dict(repair.query(spark, str(tmp_path)))
    assert got == wanted(hurt(rows), {r[0] for r in rows})
    # The SQL twin tells the same.
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert {r[0]: r[1:] for r in c.execute(f"select {', '.join(COLUMNS)} from ({repair.SQL})").fetchall()} == got


def test_repaired_turns_alternate(spark):
    rows = conversations(7, 60)
    got = repair.repaired_turns(spark.createDataFrame(rows, TURNS))
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.conv_id, r.line)):
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    want = wanted(rows)
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in by.items()} == {c: w[-1] for c, w in want.items() if c in by}
    for lines in by.values():
        initials = "".join(x[0] for x in lines)
        assert initials.removeprefix("s") == "ua" * (len(lines) // 2)


def test_empty_table(spark):
    assert as_dict(repair.repaired(spark.createDataFrame([], TURNS))) == {}
    assert repair.repaired_turns(spark.createDataFrame([], TURNS)).count() == 0
