"""URL filters, quality rules, source mixing, chat formatting."""

import re

import pytest
from pyspark.sql import functions as F

from tracehound.llm import chat, mixing, quality, urls

from .conftest import prose


def judged(spark, rows, rules):
    pages = spark.createDataFrame(rows, "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return [tuple(r) for r in urls.judge_urls(pages, table, slices=3).select("doc.page_id", "host", "path", "rule", "verdict").collect()]


def test_urls_against_all_rules(spark):
    rules = [*urls.RULES, ("a.org", "/x/", "block"), ("a.org", "/x/y", "allow"), ("a.org", "/x/y/z", "block"), ("b.a.org", "/", "allow"), ("org", "", "block"), ("dup.net", "/", "allow"), ("dup.net", "/", "block"), ("", "/", "block"), (None, None, None)]
    hosts = ["org", "a.org", "b.a.org", "c.b.a.org", "ba.org", "x.example.org", "example.org", "dup.net", "www.dup.net", "EXAMPLE.com", "m.example.com", "..org", "org.", "u@a.org:80"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/yy/", "/x/y/z/q", "/es/1", "/en/12", "/en/2", "/fr/", "/de/q?a=/fr/", "/é/", "/\U0010ffff"]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "x://"), (904, "http://a.org?q://b"), (905, "http://a.org/x/y"), (905, "http://a.org/x/y")]

    def expected(i, url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return i, host, path, best[1], best[2]

    assert sorted(judged(spark, rows, rules), key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_urls_empty_tables_and_clashing_names(spark):
    assert judged(spark, [], urls.RULES) == []
    assert judged(spark, [(1, "http://a.org/")], []) == [(1, "a.org", "/", None, "allow")]
    pages = spark.createDataFrame([(1, "http://a.org/", "h", "p", "r")], "page_id long, url string, host string, path string, row string")
    row = urls.judge_urls(pages, spark.createDataFrame(urls.RULES, "host string, path string, verdict string")).collect()[0]
    assert (row.doc.host, row.host, row.rule) == ("h", "a.org", "org/")


def by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {g for g in windows if windows.count(g) > 1} if len(windows) < 3000 else {g for g, n in __import__("collections").Counter(windows).items() if n > 1}
    hit = {i + k for i, g in enumerate(windows) if g in many for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_base_counts(spark, clashing, odd):
    extra = ["a b c a b c a b", "a a a a", "x\nx\n \n\nx y", "a b c d a b c", "#$ <a> | b", "a\u00a0b\u2028c d"]
    docs = odd.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True)
    got = {(r.doc.doc_id, r.doc.text): tuple(r)[1:6] for r in quality.judge(docs).collect()}
    assert {k: by_hand(k[1]) for k in got} == got
    out = quality.judge(clashing).select("doc.kept", "kept").collect()
    assert {r[0] for r in out} == {"mine"} and {type(r[1]) for r in out} == {bool}


def test_quality_line_rules(spark, empty):
    good = prose(5, 30)
    bad = ["Home | About | Contact | Help", "WE SELL CHEAP THINGS!!", "word*** word%%% more###", "Click here to subscribe to our list.", "Menu"]
    text = "\n".join([good, *bad, "", good[::-1].capitalize() + "."])
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.clean == "\n".join([good, "", good[::-1].capitalize() + "."]) and row.kept
    lost = "\n".join([good] + bad * 20)
    docs = spark.createDataFrame([(1, text, "e", "s", 1), (2, lost, "e", "s", 1), (3, None, "e", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = quality.cleaned(docs).collect()
    assert [(r.doc_id, r.n_chars) for r in kept] == [(1, len(row.clean))]
    assert quality.cleaned(empty).columns == empty.columns and quality.judge(empty).count() == 0


def test_water_fill(spark):
    def targets(sizes):
        s = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        return {r.source: r.target for r in mixing.water_fill(s).collect()}

    def expected(sizes):
        names = sorted(sizes, key=lambda s: (s is None, s))
        w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        full, everything = set(), sum(sizes.values())
        while True:
            left = everything - sum(3 * sizes[s] for s in full)
            open_ = [s for s in names if s not in full]
            t = {s: left * w[s] / sum(w[q] for q in open_) for s in open_}
            over = {s for s in open_ if t[s] > 3 * sizes[s]}
            if not over:
                return {s: t.get(s, 3.0 * sizes[s]) for s in names}
            full |= over

    for sizes in ({"a": 10, "b": 1000, "c": 500}, {"a": 1, "b": 1, "c": 1, None: 10_000}, {"a": 5}, {"b": 100, "a": 100, "": 100, "é": 100, "z": 3}, {"a": 1, "b": 2, "c": 900, "d": 40, "e": 1, "f": 7, "g": 2000}):
        assert targets(sizes) == pytest.approx(expected(sizes))
    assert targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0} and targets({}) == {}


def test_mix_comes_near_targets(spark, odd, empty, clashing):
    rows = [(i, "w " * (1 + i % 97), "hot" if i % 3 else f"s{i % 7}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).selectExpr("doc.doc_id", "doc.source", "size", "target", "taken", "repeats").toPandas()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 97
    assert (out["taken"] <= 3 * out["size"]).all()
    again = mixing.mix(docs.repartition(7)).selectExpr("doc.doc_id", "taken").toPandas()
    assert dict(zip(out["doc_id"], out["taken"])) == dict(zip(again["doc_id"], again["taken"]))
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns and copies.count() == out["repeats"].sum()
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() == odd.count()
    mine = mixing.mix(clashing).select("doc.size", "size").collect()
    assert {r[0] for r in mine} == {"mine"}


def test_mix_deals_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None if i % 2 else 5, f"text {i} " * (1 + i % 7), "one" if i % 3 else "two") for i in range(3000)], "doc_id long, text string, source string")
    out = mixing.mix(docs).selectExpr("doc.source", "target", "taken").toPandas()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 14


def test_preferences(spark):
    def side(pair, name, turns):
        return [(pair, name, i, r, t) for i, (r, t) in enumerate(turns)]

    u, a = ("user", "hi"), ("assistant", "hello <|end|>")
    rows = side(1, "chosen", [("system", "s"), u, a, ("user", "x"), ("assistant", "good")]) + side(1, "rejected", [("system", "s"), u, a, ("user", "x"), ("assistant", "bad"), ("user", "?")])
    rows += side(2, "chosen", [u, a]) + side(2, "rejected", [u, a]) + side(3, "chosen", [u]) + [(4, "chosen", None, None, None), (None, "chosen", 0, "user", "lost")] + side(2, "rejected", [u])
    table = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.assembled(chat.preference_format(table)).collect()}
    one = got[1]
    assert one.prompt == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\nhello < |end|><|end|>\n<|user|>\nx<|end|>\n"
    assert [one.chosen[s:e] for s, e in one.chosen_loss] == ["good<|end|>"] and [one.rejected[s:e] for s, e in one.rejected_loss] == ["bad<|end|>"]
    assert one.rejected.endswith("<|user|>\n?<|end|>\n")
    assert got[2].chosen == got[2].rejected == "" and got[2].prompt
    assert got[3].prompt == "" and got[3].chosen and got[4].chosen == "<|unknown|>\n<|end|>\n" and set(got) == {1, 2, 3, 4}
    assert chat.preference_format(table.where("false")).count() == 0


def test_pairs_are_stars(spark):
    hot = [(i, 0, "user", "same") for i in range(40)] + [(i, 1, "assistant", f"a{i % 4}") for i in range(40)] + [(7, 2, "user", "more"), (7, 3, "assistant", "end")]
    lone = [(100, 0, "user", "q"), (100, 1, "assistant", "r"), (100, 2, "user", "dangling"), (101, 0, "user", "only"), (None, 0, "user", "x")]
    table = spark.createDataFrame(hot + lone, "conv_id long, turn long, role string, text string").withColumn("best", F.lit("clash"))
    sides = chat.paired(table).toPandas()
    assert set(sides["pair_id"]) == (set(range(40)) - {7}) | {100, 101}
    chosen = sides[(sides["side"] == "chosen") & (sides["pair_id"] == 3)].sort_values("turn")
    assert list(chosen["text"]) == ["same", "a3", "more", "end"]
    echo = sides[(sides["pair_id"] == 100) & (sides["side"] == "rejected")].sort_values("turn")
    assert list(echo["text"]) == ["q", "q", "dangling"]
    # Turns behind the last answer stay, without a loss.
    parts = chat.preference_format(chat.paired(table)).where("pair_id = 100").toPandas()
    tail = parts[parts["rendered"].str.contains("dangling")]
    assert set(tail["part"]) == {"chosen", "rejected"} and (tail["loss_end"] == 0).all()
    assert chat.paired(table.where("false")).count() == 0


def test_rows_that_share_a_turn_stay(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, "user", "z"), (1, None, "user", "y"), (1, None, "user", "y")]
    rows += [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, None, None, "n")]
    rows += [(3, None, "user", "x"), (3, None, "assistant", "w"), (3, None, "assistant", "v")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.assembled(chat.preference_format(chat.paired(table))).collect()}
    said = lambda text: re.findall(r"\n(.*?)<\|end", text)
    assert said(got[2].prompt) == ["q", "a", "b"] and said(got[2].chosen) == ["y", "y", "z"] and said(got[2].rejected) == ["n"]
    assert said(got[3].chosen) == ["v", "w", "x"] and said(got[3].rejected) == ["x", "x", "x"] and set(got) == {2, 3}


def test_one_opening_over_many_shares(spark, monkeypatch):
    monkeypatch.setattr(chat, "PAIRS_A_SHARE", 3)
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"{i} {t}" if t else "same") for i in range(50) for t in range(2 + (i == 9))]
    sides = chat.paired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    chosen = sides[sides["side"] == "chosen"].groupby("pair_id")["text"].apply(sorted)
    assert len(chosen) == 49 and all(v == ["9 1", "9 2", "same"] for v in chosen)
