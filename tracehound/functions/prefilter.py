"""Plain strings that a pattern cannot match without, so that a regular expression runs only where it can hit."""

from __future__ import annotations

import re
from functools import cache
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.schema import computed

#: Clauses tested before a pattern, and strings in a clause.
CLAUSES, STRINGS = 2, 12

Clause = frozenset  # strings of which every match holds at least one


def _worth(clause: Clause) -> tuple:
    return min(map(len, clause)), -len(clause)


def _clauses(items) -> list[Clause]:
    """What every match of a sequence of parsed items holds."""
    out, run = [], ""

    def close() -> None:
        nonlocal run
        if run:
            out.append(Clause([run]))
        run = ""

    for kind, arg in items:
        if kind is op.LITERAL:
            run += chr(arg)
            continue
        if kind is op.AT:
            continue  # takes no character
        if kind is op.SUBPATTERN and len(arg[3]) and all(k is op.LITERAL for k, _ in arg[3]):
            run += "".join(chr(c) for _, c in arg[3])
            continue
        close()
        if kind is op.SUBPATTERN:
            out += _clauses(arg[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
            out += _clauses(arg[2])
        elif kind is op.BRANCH:
            sides = [_clauses(side) for side in arg[1]]
            if all(sides):
                union = Clause().union(*[max(side, key=_worth) for side in sides])
                if len(union) <= STRINGS:
                    out.append(union)
    close()
    return out


def _parsed(pattern: str):
    try:
        return _parser.parse(pattern)
    except re.error:  # a construct only the JVM knows
        return None


@cache
def needed(pattern: str) -> tuple[bool, tuple[Clause, ...]]:
    """Whether letter case is ignored (the strings are in lower case then), and the most telling clauses of a pattern."""
    tree = _parsed(pattern)
    if tree is None:
        return False, ()
    blind = bool(tree.state.flags & re.IGNORECASE) or "(?i" in pattern
    clauses = {Clause(s.lower() for s in c) if blind else c for c in _clauses(tree)}
    return blind, tuple(sorted(clauses, key=lambda c: (_worth(c), sorted(c)), reverse=True)[:CLAUSES])


@cache
def opening(pattern: str) -> tuple[str, str] | None:
    """First and last character that can stand first in a match, for patterns tied to the start of the text."""
    tree = _parsed(pattern)
    if tree is None or tree.state.flags & (re.IGNORECASE | re.MULTILINE) or not len(tree) or tree[0] != (op.AT, op.AT_BEGINNING):
        return None
    items = list(tree)
    while items and (items[0] == (op.AT, op.AT_BEGINNING) or items[0][0] is op.SUBPATTERN):
        kind, arg = items[0]
        if kind is op.SUBPATTERN and (arg[1] or not len(arg[3])):
            return None
        items = (list(arg[3]) if kind is op.SUBPATTERN else []) + items[1:]
    if not items:
        return None
    kind, arg = items[0]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
        kind, arg = arg[2][0]
    if kind is op.LITERAL and arg < 127:
        return chr(arg), chr(arg)
    if kind is op.IN and len(arg) == 1:
        if arg[0] == (op.CATEGORY, op.CATEGORY_DIGIT):
            return "0", "9"
        if arg[0][0] is op.RANGE and arg[0][1][1] < 127:
            return chr(arg[0][1][0]), chr(arg[0][1][1])
    return None


WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
CATEGORIES = {op.CATEGORY_DIGIT: frozenset("0123456789"), op.CATEGORY_WORD: WORD, op.CATEGORY_SPACE: frozenset(" \t\n\x0b\f\r")}


def _firsts(items) -> tuple[frozenset | None, bool]:
    """Characters that can stand first in a match of a sequence of parsed items (None: any), and whether it can match nothing."""
    out = frozenset()
    for kind, arg in items:
        empty = False
        if kind is op.AT:
            continue
        if kind is op.LITERAL:
            chars = frozenset(chr(arg))
        elif kind is op.IN and all(k in (op.LITERAL, op.RANGE) or (k is op.CATEGORY and a in CATEGORIES) for k, a in arg):
            chars = frozenset().union(*[{chr(a)} if k is op.LITERAL else map(chr, range(a[0], a[1] + 1)) if k is op.RANGE else CATEGORIES[a] for k, a in arg])
        elif kind is op.SUBPATTERN and not arg[1] and not arg[2]:
            chars, empty = _firsts(arg[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            chars, empty = _firsts(arg[2])
            empty = empty or arg[0] == 0
        elif kind is op.BRANCH:
            sides = [_firsts(side) for side in arg[1]]
            chars, empty = None if any(c is None for c, _ in sides) else frozenset().union(*[c for c, _ in sides]), any(e for _, e in sides)
        else:
            return None, False
        if chars is None:
            return None, False
        out |= chars
        if not empty:
            return out, False
    return out, True


@cache
def first_chars(pattern: str) -> frozenset | None:
    """Characters that can stand first in a text which a pattern tied to its start matches; None if it may be any."""
    tree = _parsed(pattern)
    if tree is None or tree.state.flags & re.MULTILINE or not len(tree) or tree[0] != (op.AT, op.AT_BEGINNING):
        return None
    chars, empty = _firsts(tree)
    if chars is None or empty:
        return None
    return frozenset(x for c in chars for x in (c, c.lower(), c.upper())) if needed(pattern)[0] else chars


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def possible(pattern: str, text: str, lowered: str | None = None) -> list[str]:
    """SQL conditions that hold for every text the pattern matches, of plain string tests only; none if nothing is known of it.

    text and lowered are SQL names of the text and of its lower-case form; without the latter, patterns that ignore case have no string test.
    """
    tests = []
    first = opening(pattern)
    if first:
        tests.append(f"startswith({text}, {quoted(first[0])})" if first[0] == first[1] else f"({text} >= {quoted(first[0])} AND {text} < {quoted(chr(ord(first[1]) + 1))})")
    blind, clauses = needed(pattern)
    if not blind or lowered is not None:
        for clause in clauses:
            tests.append("(" + " OR ".join(f"contains({lowered if blind else text}, {quoted(s)})" for s in sorted(clause)) + ")")
    return tests


def matches(pattern: str, text: str, lowered: str | None = None) -> str:
    """SQL condition `text RLIKE pattern` behind its plain string tests: it is not evaluated where one of them fails."""
    tree = _parsed(pattern)
    if tree is not None and len(tree) and not needed(pattern)[0] and all(k is op.LITERAL for k, _ in tree):
        return f"contains({text}, {quoted(''.join(chr(c) for _, c in tree))})"
    return "(" + " AND ".join([*possible(pattern, text, lowered), f"{text} RLIKE {quoted(pattern)}"]) + ")"


def count(pattern: str, text: str, lowered: str | None = None) -> str:
    """SQL number of matches of a pattern, 0 without a search where a plain string test fails."""
    tests = possible(pattern, text, lowered)
    found = f"regexp_count({text}, {quoted(pattern)})"
    return f"CASE WHEN {' AND '.join(tests)} THEN {found} ELSE 0 END" if tests else found


#: Names under which `decided` offers a text to SQL conditions: variables of their own, for a field of a struct is read anew by each test.
TEXT, LOWERED = "_text", "_lowered"


def decided(df: DataFrame, text: Column, sql: str, **more: Column) -> tuple[DataFrame, Column]:
    """The frame with the text bound once, and the column of an SQL expression over TEXT and LOWERED (and `t.<name>` of more).

    Many conditions over one text are evaluated as a tree: generated code for hundreds of them is too long for the JVM to
    compile. As one SQL text they also cost the driver one call. Drop the column `_t` afterwards.
    """
    bound = F.struct(text.alias("text"), F.lower(text).alias("lowered"), *[c.alias(n) for n, c in more.items()])
    return computed(df, _t=bound), F.expr(
        f"element_at(transform(array(_t), t -> element_at(transform(array(t.text), {TEXT} -> "
        f"element_at(transform(array(t.lowered), {LOWERED} -> {sql}), 1)), 1)), 1)"
    )


def could_match(text: str, pattern: str) -> bool:
    """`possible` for a Python string."""
    first = opening(pattern)
    blind, clauses = needed(pattern)
    seen = text.lower() if blind else text
    return (first is None or first[0] <= text[:1] <= first[1]) and all(any(s in seen for s in c) for c in clauses)
