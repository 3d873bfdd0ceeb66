"""Secret scans, SentencePiece, near copies, embeddings, language model, classifier, pipeline: against brute force, the library, or held-out labels."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracehound.llm import classifier, common, components, embeddings, lm, ngram_join, secrets, sentencepiece, shingles

from .conftest import prose

SF = "/root/testdata/sf0.001"


# Secrets


@pytest.fixture(scope="module")
def ranks():
    return secrets.word_ranks()


def base_spans(text):
    out = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_base_spans_against_plain_patterns(ranks):
    r = random.Random(3)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", "API-KEY", ":", "=", "==", " ", "   ", '"', "'", "abc", "abcdefgh", "A" * 9, "0123456789abcdef" * 2, "AKIA", "AKIAABCDEFGHIJKL", "\n", "é", "ſecret", "toKen", "/x+y_", ".", "-"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert [s[:3] for s in secrets.find(text, ranks, 20) if s[0] != "guess"] == base_spans(text), text


def test_guess_costs(ranks):
    cost = lambda v: secrets.guesses(v, ranks, 20)
    easy = ["", "password", "Password1", "changeme", "p@ssw0rd", "qwertyuiop", "aaaaaaaaaaaa", "abcabcabcabc", "12345678", "2019-12-31", "19991231"]
    hard = ["xK9!vLq2zR7#", "04dbebab91ab85687d33", "Zq8wTn3vXy"]
    assert max(map(cost, easy)) < secrets.MIN_GUESSES < min(map(cost, hard))
    assert cost("a" * 200_000) < 8 and cost("password") < cost("Password") < cost("P@ssw0rd!")
    # The split is the cheapest: a concatenation costs no more than its parts.
    for a, b in itertools.product(easy + hard, repeat=2):
        assert cost(a + b) <= cost(a) + cost(b) + 0.5  # a longer run costs a little more


def piece_cost(value, i, j, ranks):
    """The cheapest name for value[i:j], found by looking at the piece alone: a character, a word, a date, part of a repeat or of a walk."""
    low, n = value.lower(), j - i
    plain = low.translate(secrets.LEET)
    costs = [1.0] if n == 1 else []
    if n >= 3 and plain[i:j] in ranks:
        costs.append(0.3 + math.log10(ranks[plain[i:j]]) + 0.3 * (value[i:j] != low[i:j]) + 0.3 * sum(a != b for a, b in zip(plain[i:j], low[i:j])))
    for pattern in secrets.DATES:
        if (m := pattern.match(value, i)) and m.end() == j:
            costs.append(0.3 + math.log10(365 * 120) + (0.6 if m[1] else 0))
    if re.fullmatch("(19|20)[0-9]{2}", value[i:j]):
        costs.append(0.3 + math.log10(120))

    def grown(same):
        """First and last place of the longest stretch around the piece whose neighbours are all `same`, or None."""
        a, b = i, j
        if not all(same(k) for k in range(i + 1, j)):
            return None
        while a > 0 and same(a):
            a -= 1
        while b < len(value) and same(b):
            b += 1
        return a, b

    for p in (1, 2, 3, 4):
        if n >= max(3, 2 * p) and all(low[k] == low[k - p] for k in range(i + p, j)):
            a, b = i, j
            while a > 0 and low[a - 1] == low[a - 1 + p]:
                a -= 1
            while b < len(value) and low[b] == low[b - p]:
                b += 1
            costs.append(0.3 + p + math.log10((b - a) / p))

    def move(k):
        d = ord(low[k]) - ord(low[k - 1])
        return d if d in (1, -1) else "key" if low[k - 1] + low[k] in secrets.BESIDE else None

    if n >= 3 and (run := grown(lambda k: move(k) is not None)):
        moves = [move(k) for k in range(run[0] + 1, run[1])]
        costs.append(0.3 + 1.6 + math.log10(run[1] - run[0]) + 0.6 * sum(x != y for x, y in zip(moves, moves[1:])))
    return min(costs, default=math.inf)


def test_split_is_the_cheapest_of_all_splits(ranks):
    r = random.Random(11)
    bits = ["pass", "word", "dragon", "1999", "2019", "-12-", "31", "qwe", "rty", "aaa", "abab", "abc", "321", "P@ss", "x", "K", "9", "!", "é", "Haus", "0"]
    for _ in range(250):
        v = "".join(r.choice(bits) for _ in range(r.randint(1, 5)))[:11]
        price = {(i, j): piece_cost(v, i, j, ranks) for i in range(len(v)) for j in range(i + 1, len(v) + 1)}
        splits = ([0, *cuts, len(v)] for k in range(len(v)) for cuts in itertools.combinations(range(1, len(v)), k))
        expected = min(sum(price[p] for p in zip(s, s[1:])) for s in splits)
        assert secrets.guesses(v, ranks, 20) == pytest.approx(expected), v


def test_guessed_values_in_context(ranks):
    found = secrets.find("pwd: xK9!vLq2zR7, Passwort: Haus. my password is: changeme private key = Zq8wTn3vXy98", ranks, 20)
    assert [s[0] for s in found] == ["guess", "guess"]
    # Values that the fixed patterns miss, for they hold symbols or stand behind other words; and those of patterns are judged as well.
    for text, value in [("Kennwort: v#Q7!kzP2&", "v#Q7!kzP2&"), ("contraseña = (Jw8^tRb5%x", "(Jw8^tRb5%x"), ("mot de passe : Xk2?dLm9+q", "Xk2?dLm9+q"), ("password: m$N4vB7*zK", "m$N4vB7*zK")]:
        assert [text[s[1] : s[2]] for s in secrets.find(text, ranks, 20) if s[0] == "guess"] == [value]
    both = secrets.find("token=Zq8wTn3vXy98Lk", ranks, 20)
    assert [s[:3] for s in both] == [("assign", 0, 20), ("guess", 6, 20)] and both[0][4] is None and both[1][4] >= secrets.MIN_GUESSES
    assert [s[0] for s in secrets.find("password=passwordpassword", ranks, 20)] == ["assign"]
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    assert secrets.redact(text, secrets.find(text, ranks, 20)) == 'token = "[SECRET]" end'
    assert secrets.redact(None, []) is None and secrets.redact("", []) == ""


def test_scan_of_odd_rows(spark, odd, empty, clashing):
    got = secrets.scan(odd).collect()
    assert len(got) == odd.count() and secrets.scan(empty).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    assert all((r.base_sha256 == nothing) == (r.doc_id != 13) for r in got)
    out = secrets.without_secrets(clashing)
    assert out.columns == clashing.columns and out.schema == clashing.schema
    assert out.where("text LIKE '%[SECRET]%'").select("doc_id", "new_text", "n_chars").collect() == [(13, "mine", 20)]


# SentencePiece


def strange_texts():
    r = random.Random(1)
    fixed = ["", None, " ", "  ", "a", "   a  b ", "日本語のテキスト、長い" * 30, "aaaa" * 50, "▁x y▁", "x\ty\r\nz\x00", "    " * 9 + "q", "ééé😀🏽" + "🚀" * 70, "thequickbrownfox" * 20, "1234567890" * 33]
    return fixed + ["".join(r.choice("ab ▁\nеthe中 é😀") for _ in range(r.randint(1, 90))) for _ in range(400)] + [prose(9, 3000), "x" * 5000]


def test_ids_as_the_library():
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=sentencepiece.default_model())
    coder = sentencepiece.Coder(sentencepiece.default_model())
    for texts in (strange_texts(), strange_texts()[::-1]):
        flat, ends = coder.encode(texts)
        for t, a, b in zip(texts, [0, *ends[:-1]], ends):
            assert flat[a:b].tolist() == sp.encode(t or ""), t
            if "▁" not in (t or ""):
                assert coder.decode(flat[a:b].tolist()) == (t or "")


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(sentencepiece, "REMEMBERED", 3)
    monkeypatch.setattr(sentencepiece, "BLOCK", 40)
    coder, whole = sentencepiece.Coder(sentencepiece.default_model()), sentencepiece.Coder(sentencepiece.default_model())
    texts = strange_texts()[:60]
    monkeypatch.setattr(sentencepiece, "BLOCK", 40)
    a = [coder.encode([t])[0].tolist() for t in texts]
    monkeypatch.setattr(sentencepiece, "REMEMBERED", 10**6)
    flat, ends = whole.encode(texts)
    assert a == [flat[x:y].tolist() for x, y in zip([0, *ends[:-1]], ends)]


def test_encoded_and_decoded(spark, odd, empty, clashing):
    out = sentencepiece.encoded(odd, keep=["doc_id", "text"])
    assert out.where("NOT same").count() == 0 and sentencepiece.encoded(empty).count() == 0
    back = sentencepiece.decoded(out.withColumnRenamed("text", "was"), keep=["doc_id", "was"]).where("text != coalesce(was, '')")
    assert back.count() == 0
    assert sentencepiece.encoded(clashing).select("ids", "host").first()["host"] == "mine"


# Near copies


def sets_by_hand(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def groups_by_hand(rows, size, percent):
    sets = [(i, sets_by_hand(t, size)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def edited(seed):
    """Copies with few to many edits, so that similarities lie on both sides of the threshold; short texts; chains."""
    r = random.Random(seed)
    rows = []
    for k in range(12):
        base = prose(1000 * seed + k, r.choice([3, 4, 5, 6, 7, 9, 13, 20, 40, 90, 200, 400])).split()
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                if r.random() < 0.5:
                    w[r.randrange(len(w))] = f"e{r.randint(0, 5)}"
                else:
                    del w[r.randrange(len(w))]
            rows.append(" ".join(w))
            base = w if r.random() < 0.3 else base
    return list(enumerate(rows))


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (1, 50)])
def test_groups_against_all_pairs(spark, monkeypatch, size, percent):
    rows = edited(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = groups_by_hand(rows, size, percent)
    for block, least in ((1024, 50), (3, 2)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "COMMON_LEAST", least)
        assert {tuple(r) for r in ngram_join.jaccard_groups(docs, size=size, percent=percent).collect()} == expected


def test_a_large_family_is_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    r = random.Random(6)
    sizes = [r.randint(1, 400) for _ in range(300)] + [77] * 60
    members = spark.createDataFrame([(i, -i, n, 5) for i, n in enumerate(sizes)] + [(900, -900, 9, 6), (901, -901, 9, 7), (902, -902, 400, 7)], "rep long, d1 long, n int, family long")
    keys = collections.defaultdict(list)
    for row in ngram_join.paired_blocks(members, 80).collect():
        keys[row.key].append((row.rep, row.side))
    met = collections.Counter(frozenset((a, b)) for k, rows in keys.items() for (a, s), (b, t) in itertools.combinations(rows, 2) if k.endswith("=") or s != t)
    assert set(met.values()) == {1} and frozenset((901, 902)) in met and not any(900 in pair for pair in met)
    for i, j in itertools.combinations(range(len(sizes)), 2):
        if 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j]):
            assert frozenset((i, j)) in met
    assert max(map(len, keys.values())) <= 2 * 15
    assert sum(map(len, keys.values())) < len(sizes) * 36 / 2  # a member met all 36 blocks before


def test_shares_of_large_families(spark, monkeypatch):
    rows = edited(4)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "AT_ONCE", 1)
    names, write = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, folder, name: names.append(name) or write(df, folder, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in ngram_join.jaccard_groups(docs, size=4, percent=85).collect()} == groups_by_hand(rows, 4, 85)
    assert {"links0", "links1"} <= set(names)


def test_what_is_written_leaves_no_shuffle_files(spark):
    kept = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    folder, before = common.shared_folder(spark), kept()
    out = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")).repartition(3, "s"), folder, "sums")
    time.sleep(1)
    assert kept() <= before
    assert out.count() == 7


def test_linked_sets_share_a_signature():
    r = random.Random(2)
    for n in [*range(1, 60), 100, 333, 1000, 5000]:
        for percent in (80, 85):
            for _ in range(4):
                a = set(r.sample(range(10**9), n))
                out = r.randint(0, n * (100 - percent) // 100)
                b = set(r.sample(sorted(a), n - out)) | set(r.sample(range(10**9, 2 * 10**9), r.randint(0, n * (100 - percent) // 100 - out + 1)))
                if a != b and 100 * len(a & b) >= percent * len(a | b):
                    for share in (0, 0.1, 0.25, 0.4, 1):
                        hot = np.array(sorted(x for x in a | b if r.random() < share), np.uint64)
                        x, y = (set(ngram_join.signatures(np.array(sorted(s), np.uint64), percent, hot).tolist()) for s in (a, b))
                        assert x & y, (n, len(b), percent, share)


def test_trees_lose_no_pair():
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 2**62, k).astype(np.uint64)) for k in (5, 30, 200)]
    sets = [np.unique(np.concatenate([b[r.random(len(b)) > 0.05], r.integers(0, 2**62, 2).astype(np.uint64)])) for b in base for _ in range(40)]
    sets.sort(key=len)
    tree = ngram_join.Tree(sets, 512)
    found = {(int(i), int(j)) for a, b in ngram_join.dual_traversal(tree, tree, 85) for i, j in zip(a, b)}
    for i, j in itertools.combinations(range(len(sets)), 2):
        if ngram_join.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])), 85):
            assert (i, j) in found


def test_groups_of_odd_rows(spark, odd, empty, clashing):
    got = {(r.id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(odd).collect()}
    rows = [(r.doc_id, r.text) for r in odd.where("doc_id IS NOT NULL").distinct().collect()]
    assert {g for g in got if g[0] is not None} == groups_by_hand(rows, 4, 85)
    assert ngram_join.jaccard_groups(empty).count() == 0
    kept = ngram_join.one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids == [1, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, None]


def test_one_of_each_with_repeated_and_missing_ids(spark):
    near = prose(1).split()
    near[60] = "changed"
    rows = [(1, prose(2), "b"), (1, prose(3), "a"), (1, prose(3), "c"), (2, prose(1), "a"), (None, " ".join(near), "a"), (None, prose(5), "a"), (None, prose(5), "z"), (3, prose(2), "a"), (7, None, "a"), (7, None, "a"), (None, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = {(1, prose(2)), (1, prose(3)), (2, prose(1)), (None, prose(5)), (7, None), (None, "")}
    first = ngram_join.one_of_each(docs).collect()
    assert {(r.doc_id, r.text) for r in first} == expected and len(first) == len(expected) + 1
    again = ngram_join.one_of_each(docs.repartition(5)).collect()
    assert sorted(first, key=repr) == sorted(again, key=repr)


def test_word_hashes_follow_words():
    texts = ["a b  c", "a", "", " \n", "ab c", "é b", "x" * 1000 + " y"]
    seen = {}
    for t in texts:
        h, _ = shingles.word_hashes(t.encode())
        for w, x in zip(re.findall(r"[^\x20\x09-\x0D]+", t), h):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7), (200, 201)] + [(300, k) for k in range(301, 360)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200, **{k: 300 for k in range(300, 360)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Embeddings


def test_links_against_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = [r.normal(size=16) for _ in range(300)]
    x += [x[i % 60] + r.normal(size=16) * s for i, s in enumerate(np.linspace(0.02, 0.6, 400))] + [x[5]] * 30 + [3 * x[6]]
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 15 + [float("inf")], [1.0, 2.0], [2.0, 4.0], [1e-200] * 16, [1e200] * 16]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    table = spark.createDataFrame([(i, v, "mine") for i, v in rows], "vec_id long, embedding array<double>, n string")
    good = [(i, np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = collections.defaultdict(set)
    for (i, a), (j, b) in itertools.combinations(good, 2):
        if len(a) == len(b) and a @ b >= 0.9:
            links[i].add(j)
            links[j].add(i)

    def smallest(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    expected = {(i, len(links[i]), smallest(i), smallest(i) == i) for i, _ in rows}
    for block in (embeddings.BLOCK, 40):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        assert {tuple(q) for q in embeddings.near_groups(table).collect()} == expected
    assert embeddings.near_groups(table.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_are_not_shuffled_for_the_cells_they_visit(spark, monkeypatch, kind):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 24)).astype(np.float32)  # without clusters, so that most cells are near
    x[400:] = x[:100] + r.normal(size=(100, 24)).astype(np.float32) * 0.05
    x[490], x[491] = x[3], np.where(np.arange(24) == 0, -0.0, x[4])
    x[492] = np.where(np.arange(24) == 0, 0.0, x[4])
    table = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    sizes, write = {}, embeddings.written

    def rows_of(df, folder, name):
        sizes[name] = (out := write(df, folder, name)).count()
        return out

    monkeypatch.setattr(embeddings, "written", rows_of)
    monkeypatch.setattr(embeddings, "BLOCK", 60)
    got = {q.id: (q.n_links, q.component_id) for q in embeddings.near_groups(table).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    assert {i: n for i, (n, _) in got.items()} == {i: int(near[i].sum()) - 1 for i in range(500)}
    assert all(got[i][1] == got[i - 400][1] for i in range(400, 490) if near[i, i - 400])
    assert sizes["classes"] == 498 and sizes["cells24"] <= 498 / 60 + 3  # a row per block; it was one per vector and cell visited


# Language model


def test_base_score_and_odd_rows(spark, odd, empty, clashing):
    learn = ~(F.coalesce(F.col("doc_id"), F.lit(0)) % 7 == 2)
    got = lm.score(clashing, ~learn, frequent=20).collect()
    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\0"]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    c = collections.Counter(w for i, t in rows if (i or 0) % 7 != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), (i or 0) % 7 == 2, len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert sorted((repr(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(empty, F.lit(False)).count() == 0
    untrained = lm.score(odd, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in untrained} == {(0, 0)} and all(math.isfinite(r.score) for r in untrained)


def test_probabilities_are_normalised():
    import pandas as pd

    model = lm.first_model(pd.DataFrame({"h": [5, 9, lm.END], "cls": [0, 1, -1], "c": [7, 3, 4]}), np.arange(lm.CLASSES) + 10.0, 256)
    v = len(model.noise)
    s, c = np.arange(v), np.tile(np.random.default_rng(1).integers(0, v, lm.CONTEXT), (v, 1))
    assert np.exp(lm.log_probs(model, s, c)).sum() == pytest.approx(1, abs=1e-4)


def test_model_beats_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.query(spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == docs.count()
    out = got[got["held_out"]]
    assert set(out["doc_id"]) == {i for i in got["doc_id"] if zlib.crc32(str(i).encode()) % 7 == 2}
    assert out["score"].sum() > out["base_score"].sum() + 0.1 * out["n_tokens"].sum()


# Classifier


def test_chunks_cover_the_text():
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 960, 961, 5000):
        text = "".join(chr(33 + i % 90) for i in range(n))
        c = classifier.chunks(text)
        step = classifier.CHUNK - classifier.OVERLAP
        back = np.concatenate([c[0], *[x[classifier.OVERLAP :] for x in c[1:]]])
        assert bytes(back[back != classifier.PAD].astype(np.uint8)) == text.encode() and len(c) == max(1, -(-max(n - classifier.OVERLAP, 1) // step))


def test_held_out_accuracy(spark):
    got = classifier.query(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = got.where("held_out").join(labels, "doc_id").toPandas()
    assert (out["predicted"] == out["quality"]).mean() >= 0.93
    assert out[out["quality"] == 1]["score"].median() > 0.8 > 0.3 > out[out["quality"] == 0]["score"].median()


def test_scores_of_odd_rows(spark, odd, empty):
    net = classifier.fit([prose(i) for i in range(20)] + ["### " * 50] * 20, np.array([1.0] * 20 + [0.0] * 20, np.float32), rounds=4)
    got = {r.doc_id: r.score for r in classifier.classify(odd, net).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[4] == got[5] and classifier.classify(empty, net).count() == 0
    one = [net.scores([t])[0] for t in (prose(1), prose(7, 9000), "", None)]
    assert net.scores([prose(1), prose(7, 9000), "", None]) == pytest.approx(one, abs=1e-6)
    for labels, texts in (([], []), ([1, 1], ["a", None]), ([0], [""])):
        assert np.isfinite(classifier.fit(texts, np.array(labels, np.float32)).scores(["x"])).all()


# Pipeline


def test_pipeline_stages(spark, odd, empty, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows, before = out.collect(), docs.collect()
        assert out.columns[: len(docs.columns)] == docs.columns
        if name == "ngram_join":
            by_hand = groups_by_hand([(r.doc_id, r.text) for r in before], 5, 80)
            assert sorted(r.doc_id for r in rows) == sorted(i for i, _, c in by_hand if i == c)
        if name == "secret_scans":
            assert len(rows) == len(before) and not any(base_spans(r.text) for r in rows)
        if name == "source_mixing":
            most = collections.Counter(r.doc_id for r in rows)
            assert max(most.values()) <= 3 and set(most) <= {r.doc_id for r in before}
        if name == "sentencepiece":
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before) and all(r.same for r in rows)
        assert all(r.n_chars == len(r.text) for r in rows)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    for case, table in (("odd", odd), ("empty", empty)):
        table.write.parquet(str(tmp_path / case / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / case)).count() == 0 or case == "odd"
