"""Token counts and cross-tokenizer alignment beside the libraries and a plain alignment."""

import bisect
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracehound.llm import alignment, skew, token_counts

from .conftest import odd_documents, prose

BPE, WORDS_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def strange() -> list:
    r = random.Random(5)
    fixed = ["", None, " ", "  ", "a", "   a  b ", "日本語のテキスト、長い" * 30, "▁x y▁", "x\ty\r\nz\x00 b", "<|endoftext|>", "a <|endoftext|> b", "<s> </s> <unk> <0x41>", "ééé😀🏽" + "🚀" * 70, "thequickbrownfox" * 20, "1234567890" * 33]
    return fixed + ["".join(r.choice("ab \nеthe中 é😀's" + "▁" * (k % 2)) for _ in range(r.randint(1, 90))) for k in range(200)] + [prose(9, 3000), prose(1) + " ", "x" * 5000]


# Token counts


@pytest.mark.parametrize("file", [BPE, WORDS_BPE, PIECES])
def test_counts_equal_the_library(file):
    t = token_counts.Tokenizer(file)
    texts = strange() + [prose(3, 90_000) + "  \n <|endoftext|> " + prose(4, 40_000)]
    lib = t.load()
    want = [len(lib.encode(x or "")) if file == PIECES else len(lib.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert t.counts(texts) == want
    assert t.cuts == (file == BPE) and (not t.cuts or len(list(t.parts(texts[-1]))) > 2)


def counted(spark, tmp_path, rows, file=BPE, cache="cache", **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string") if isinstance(rows, list) else rows
    return token_counts.token_counts(docs, f"{tmp_path}/{cache}", file, **options)


def test_cache_is_asked_first_and_appended_to(spark, tmp_path):
    first = counted(spark, tmp_path, [(1, "one two"), (2, "one two"), (3, "three")]).collect()
    assert [r.n_tokens for r in sorted(first)] == [2, 2, len(token_counts.Tokenizer(BPE).load().encode("three").ids)]
    version = token_counts.Tokenizer(BPE).version
    cache = spark.read.parquet(f"{tmp_path}/cache")
    assert cache.where(F.col("tokenizer") == version).count() == 2  # one row a content
    # What is stored counts: a planted figure comes back, and nothing is encoded again.
    planted = spark.createDataFrame([(hashlib.sha256(b"planted").digest(), 777, version), (hashlib.sha256(b"other").digest(), 5, "another version")], token_counts.CACHE)
    planted.write.mode("append").partitionBy("tokenizer").parquet(f"{tmp_path}/cache")
    again = {r.doc_id: r for r in counted(spark, tmp_path, [(1, "planted"), (2, "other"), (3, "three")], limit=100).collect()}
    assert again[1].n_tokens == 777 and again[1].over_limit and again[2].n_tokens == 1 and not again[2].over_limit
    assert spark.read.parquet(f"{tmp_path}/cache").where(F.col("tokenizer") == version).count() == 4
    # Another tokenizer shares the table, not the counts.
    assert counted(spark, tmp_path, [(1, "planted")], file=PIECES).first().n_tokens == len(token_counts.Tokenizer(PIECES).load().encode("planted"))


def test_contents_that_normalise_alike_share_a_count(spark, tmp_path):
    texts = ["Hello  World", "hello world", "HELLO\tWORLD", "<|startoftext|>", "<|STARTOFTEXT|>", None, ""]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.n_tokens for r in counted(spark, tmp_path, rows, file=WORDS_BPE).collect()}
    lib = token_counts.Tokenizer(WORDS_BPE).load()
    assert got == {k: len(lib.encode(t or "", add_special_tokens=False).ids) for k, t in rows}
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 4


def test_counts_of_odd_rows(spark, tmp_path, odd, empty, clashing):
    lib = token_counts.Tokenizer(BPE).load()
    want = sorted((d[0] is None, d[0] or 0, len((d[1] or "").encode()), len(lib.encode(d[1] or "").ids)) for d in odd_documents())
    got = counted(spark, tmp_path, odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert counted(spark, tmp_path, empty, cache="none").count() == 0
    assert counted(spark, tmp_path, clashing, cache="third").columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_hot_contents(spark, tmp_path):
    rows = [(k, "same text") for k in range(400)] + [(None, "no id")] * 300 + [(k, f"text {k}") for k in range(100)]
    got = counted(spark, tmp_path, rows).groupBy("n_tokens").count().collect()
    assert sum(r["count"] for r in got) == 800
    sizes = spark.createDataFrame([("h", 900), ("c", 3)], "k string, n long")
    left = spark.createDataFrame([("h",)] * 900 + [("c",)] * 3, "k string")
    assert {r.v: r["count"] for r in skew.joined(left, sizes.select("k", F.col("n").alias("v")), "k", sizes).groupBy("v").count().collect()} == {900: 900, 3: 3}


# Alignment


def plain_alignment(texts: list) -> list[tuple]:
    """Groups between common ends, links by overlap of every two tokens of a group."""
    a, b = (alignment.Side(token_counts.Tokenizer(f)) for f in (BPE, PIECES))
    lib_a, lib_b = a.tokenizer.load(plain=True), b.tokenizer.load()
    rows, counts = [], collections.Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        ids = lib_a.encode(" " + t, add_special_tokens=False).ids if t else [], lib_b.encode(t) if t else []
        raw = [a.bytes[i] for i in ids[0]], [b.bytes[i] for i in ids[1]]
        if not t or b"".join(raw[0]) != whole or b"".join(raw[1]) != whole:
            rows.append(None)
            continue
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        groups, links, at = [], [], [0, 0]
        for c in sorted(set(ends[0]) & set(ends[1])):
            inside = []
            for s in (0, 1):
                until = bisect.bisect_left(ends[s], c) + 1
                inside.append(range(at[s], until))
                at[s] = until
            groups.append("|".join(",".join(str(ids[s][k]) for k in inside[s]) for s in (0, 1)))
            links += [(ids[0][p], ids[1][q]) for p in inside[0] for q in inside[1] if max(ends[0][p] - len(raw[0][p]), ends[1][q] - len(raw[1][q])) < min(ends[0][p], ends[1][q])]
        counts.update(links)
        rows.append((len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [none if r is None else (*r[:3], len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(r[4].encode()).hexdigest()) for r in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [alignment.PAIRS, 300])
def test_alignment_against_plain(spark, most, monkeypatch):
    texts = strange() + [prose(20, 9000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = alignment.alignments(docs, BPE, PIECES, most=most).orderBy("doc_id").select(*COLUMNS).collect()
    want = plain_alignment(texts)
    assert [tuple(r) for r in got] == want and sum(w[0] > 0 for w in want) > 60


def test_lanes_and_blocks_change_nothing(monkeypatch):
    texts = [prose(k, 900) for k in range(4)] + strange()
    sides = [token_counts.Tokenizer(f) for f in (BPE, PIECES)]
    whole = alignment.Aligner(*sides)
    whole.cuts = False
    want = whole.columns(texts)
    monkeypatch.setattr(alignment, "LANE", 3)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    monkeypatch.setattr(alignment, "AT_ONCE", 300)
    got = alignment.Aligner(*sides).columns(texts)
    for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"):
        assert list(got[c]) == list(want[c]), c


def test_group_ends_against_common_ends():
    r = np.random.default_rng(4)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a, b = (np.union1d(r.choice(n, int(r.integers(0, n)), replace=False) + 1, [n]) for _ in range(2))
        if r.random() < 0.3:
            b = np.union1d(a[r.random(len(a)) < 0.9], [n])
        one = np.array([0])
        cut_a, cut_b = alignment.group_ends(a, b, one, np.array([len(a)]), one, np.array([len(b)]))
        common = np.intersect1d(a, b)
        assert a[cut_a].tolist() == common.tolist() == b[cut_b].tolist()


def test_alignment_of_odd_rows(spark, odd, empty, clashing):
    rows = odd_documents()
    got = alignment.alignments(odd, BPE, PIECES).collect()
    want = plain_alignment([d[1] for d in rows])
    assert sorted((str(r.doc_id), *[r[c] for c in COLUMNS]) for r in got) == sorted((str(d[0]), *w) for d, w in zip(rows, want))
    assert alignment.alignments(empty, BPE, PIECES).count() == 0
    assert alignment.alignments(clashing, BPE, PIECES).columns == ["doc_id", *COLUMNS]
