"""Secret scans: fixed patterns, and values in credential context that a password guesser would need long to find."""

from __future__ import annotations

import hashlib
import json
import os
import re
from math import inf, log10

from pyspark.sql import DataFrame

from tracehound.llm.common import arrow_map, table, with_text

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words before `:` or `=` that make what follows a credential.
CONTEXT = re.compile(
    r"""(?ai)(?:passwor[dt]|passwd|passphrase|passcode|pwd|secret|token|credentials?|authorization|bearer|kennwort|contraseña|mot de passe"""
    r"""|(?:api|access|private|encryption)[ _-]?key)["'\]]?\Z"""
)
VALUE = re.compile(r"""\x20*["'\[]?(?:bearer |basic )?([^\x20\x09-\x0D"'<>\[\],;]+)""", re.I)
ANCHOR = re.compile("[:=]")
#: Decimal exponent of the guesses from which a value counts as a secret.
MIN_GUESSES = 8.0

#: Passwords people choose first, most common first.
COMMON = (
    "123456 password qwerty letmein dragon monkey admin welcome login master hello abc123 iloveyou sunshine princess football shadow"
    " superman trustno1 changeme secret default guest root test pass user example sample demo placeholder dummy yourpassword"
).split()
LEET = str.maketrans("@4310$57", "aaelosst")
ROWS = ("1234567890", "qwertzuiop", "qwertyuiop", "asdfghjkl", "yxcvbnm", "zxcvbnm", "azertyuiop", "qsdfghjklm", "wxcvbn")
BESIDE = {a + b for r in ROWS for a, b in [*zip(r, r[1:]), *zip(r[1:], r)]}
DATES = (
    re.compile(r"(?:19|20)\d\d([-/._]?)(?:1[0-2]|0?[1-9])\1(?:3[01]|[12]\d|0?[1-9])"),
    re.compile(r"(?:3[01]|[12]\d|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\1(?:19|20)?\d\d"),
)
YEAR = re.compile(r"(?:19|20)\d\d")


def word_ranks(vocabulary: str | None = None) -> dict[str, int]:
    """Whole words of a public tokenizer's vocabulary (a JSON file whose ids follow frequency), ranked; common passwords first. At most as many as the file has."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    ids = json.load(open(os.fspath(vocabulary), encoding="utf-8"))["model"]["vocab"]
    found = [w[:-4] for w in sorted(ids, key=ids.get) if w.endswith("</w>") and len(w) > 6 and w[:-4].isalpha()]
    return {w: r for r, w in reversed(list(enumerate(COMMON + found, 1)))}


def _runs(value: str):
    """(start, end, least length, cost) of maximal repeats of blocks of up to four characters and of keyboard walks and sequences."""
    n = len(value)
    for p in (1, 2, 3, 4):
        start = 0
        for i in range(p, n + 1):
            if i == n or value[i] != value[i - p]:
                if i - start >= max(3, 2 * p):
                    yield start, i, max(3, 2 * p), p + log10((i - start) / p)
                start = i - p + 1
    low = value.lower()
    start, turns, step = 0, 0, None
    for i in range(1, n + 1):
        d = ord(low[i]) - ord(low[i - 1]) if i < n else 9
        move = d if d in (1, -1) else "key" if i < n and low[i - 1] + low[i] in BESIDE else None
        if move is None:
            if i - start >= 3:
                yield start, i, 3, 1.6 + log10(i - start) + 0.6 * turns
            start, turns, step = i, 0, None
        else:
            turns += step is not None and move != step
            step = move


def guesses(value: str, ranks: dict[str, int], longest: int) -> float:
    """Decimal exponent of the guesses for a value: the cheapest split into words, dates, repeats, keyboard walks and brute-force spans.

    A word costs its rank, more with capitals or digits for letters; a date its place among those of 120 years; a repeat
    its block and count; a walk its start, length and turns; each other character a factor of ten. The work is linear in
    the value. An empty value costs nothing.
    """
    n = len(value)
    low = value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(LEET)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i in (i for i, c in enumerate(value) if c in "0123456789"):
        for pattern in DATES:
            if m := pattern.match(value, i):
                ends[m.end()].append((i, log10(365 * 120) + (0.6 if m[1] else 0)))
        if YEAR.match(value, i):
            ends[i + 4].append((i, log10(120)))
    runs = sorted(_runs(low), reverse=True)
    live: list[list] = []
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        least = best[j - 1] + 1.0
        for i in range(max(0, j - longest), j - 2):
            rank = ranks.get(plain[i:j])
            if rank is not None and best[i] + 0.3 < least:
                cost = log10(rank) + 0.3 * (value[i:j] != low[i:j]) + 0.3 * sum(x != y for x, y in zip(plain[i:j], low[i:j]))
                least = min(least, best[i] + cost + 0.3)
        for i, cost in ends[j]:
            least = min(least, best[i] + cost + 0.3)
        while runs and runs[-1][0] < j:
            live.append([*runs.pop(), inf])
        live = [x for x in live if x[1] >= j]
        for x in live:  # any part of a run costs as the run; x[4] is the cheapest way to where a part can start
            if j - x[2] >= x[0]:
                x[4] = min(x[4], best[j - x[2]])
                least = min(least, x[4] + x[3] + 0.3)
        best[j] = least
    return best[n]


def find(text: str | None, ranks: dict[str, int], longest: int, min_guesses: float = MIN_GUESSES) -> list[tuple[str, int, int, int, float | None]]:
    """Secrets of a whole text as (kind, start, end, start of the value, exponent of its guesses), by start, then kind. Null is as empty.

    Every value in credential context is split, also where a fixed pattern holds it already; fixed patterns have no exponent.
    """
    if not text:
        return []
    out, values, upto = [], [], 0
    for anchor in ANCHOR.finditer(text):
        a = anchor.start()
        k = a
        while k and text[k - 1] == " ":
            k -= 1
        before = text[max(0, k - 24) : k]
        # A keyword ends at its quote or here, so the pattern can only start where one of its five words does.
        word = before[:-1] if before[-1:] in "\"'" else before
        tail = word[-8:].lower()
        size = next((len(w) for w in ("password", "api_key", "passwd", "secret", "apikey", "token") if tail.endswith(w)), 0)
        if size and (start := k - len(before) + len(word) - size) >= upto and (m := ASSIGN.match(text, start)):
            upto = m.end()
            if len(m[2]) >= 8:
                out.append(("assign", m.start(), m.end(), m.start(2), None))
        if CONTEXT.search(before) and (m := VALUE.match(text, a + 1)):
            values.append(m)
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), None) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m.start(), None) for m in HEX.finditer(text)]
    for m in values:
        value = m[1].rstrip(".!?:)}")
        start = m.start(1)
        if (cost := guesses(value, ranks, longest)) >= min_guesses:
            out.append(("guess", start, start + len(value), start, cost))
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None, spans: list[tuple], mark: str = "[SECRET]") -> str | None:
    """The text with the values of its secrets replaced; values that overlap get one mark."""
    if text is None or not spans:
        return text
    parts, at = [], 0
    for start, end in sorted((v, e) for _, _, e, v, _ in spans):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


class Scanner:
    """Finds and redacts in tasks; the word table goes out with it once, and its size is that of the vocabulary file."""

    def __init__(self, spark, vocabulary: str | None = None, min_guesses: float = MIN_GUESSES) -> None:
        self.ranks, self.min_guesses = spark.sparkContext.broadcast(word_ranks(vocabulary)), min_guesses

    def find(self, text: str | None) -> list[tuple]:
        return find(text, self.ranks.value, 20, self.min_guesses)

    def redacted(self, texts: list) -> list:
        return [redact(t, self.find(t)) for t in texts]

    def digests(self, texts: list) -> dict:
        out = {c: [] for c in ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "costs")}
        for found in map(self.find, texts):
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[0] == k for x in found))
            named = [(x[0], f"{x[0]}:{x[1]}:{x[2]}") for x in found]
            out["base_sha256"].append(hashlib.sha256(",".join(s for k, s in named if k != "guess").encode()).hexdigest())
            out["spans"].append(",".join(s for _, s in named))
            out["costs"].append(",".join(f"{x[1]}:{x[2]}:{x[4]:.2f}" for x in found if x[4] is not None))
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, min_guesses: float = MIN_GUESSES) -> DataFrame:
    """Secrets of every whole text: id, counts by kind, a digest of the base spans, all spans as kind:start:end (code points, end exclusive),
    and the decimal exponent of the guesses for each value that is a secret by them, as start:end:exponent.

    Null and empty texts have none. Repeated rows get a row each; other columns are not read; an empty table gives none.
    """
    scanner = Scanner(docs.sparkSession, vocabulary, min_guesses)
    return arrow_map(docs, text_col, scanner.digests, "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, costs string", keep=[id_col])


def without_secrets(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, min_guesses: float = MIN_GUESSES) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    return with_text(docs, text_col, Scanner(docs.sparkSession, vocabulary, min_guesses).redacted)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
