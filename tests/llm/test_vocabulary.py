"""The language model's vocabulary follows the corpus."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracehound.llm import lm


def test_probabilities_of_many_symbols():
    counts = np.arange(3_000) % 97 + 10
    words = pd.DataFrame({"h": np.arange(3_000) * 7, "cls": np.arange(3_000) % lm.CLASSES, "c": counts})
    model = lm.first_model(words, np.bincount(words["cls"], weights=counts, minlength=lm.CLASSES) + 5.0, 3_000 + lm.CLASSES + 1)
    v = len(model.noise)
    assert v == 3_000 + lm.CLASSES + 1
    s, c = np.arange(v), np.tile(np.random.default_rng(1).integers(0, v, lm.CONTEXT), (v, 1))
    assert np.exp(lm.log_probs(model, s, c).astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)
    assert np.array_equal(np.sort(model.symbols(words["h"].to_numpy(), words["cls"].to_numpy())), np.setdiff1d(s, [*model.rare, model.symbols(np.array([lm.END]), np.array([-1]))[0]]))
    model.params["outputs"][:] = model.params["classes"][:] = 0
    assert np.exp(lm.log_probs(model, s, c)) == pytest.approx(model.noise, rel=1e-3)


def test_noise_contrast_learns_the_conditional_shares():
    """Two contexts with known next symbols: estimation from noise alone comes near their conditional probabilities."""
    words = pd.DataFrame({"h": np.arange(20), "cls": np.zeros(20, int), "c": np.full(20, 100)})
    model = lm.first_model(words, np.bincount(words["cls"], weights=words["c"], minlength=lm.CLASSES), 20 + lm.CLASSES + 1)
    r = np.random.default_rng(0)
    first, second = r.integers(0, 2, 200_000), r.integers(0, 5, 200_000)
    target, context = first * 5 + second + 5, np.tile(first[:, None], (1, lm.CONTEXT))
    trainer = lm.Trainer(model, 1)
    drawn = []
    draw = trainer.drawn
    trainer.drawn = lambda upto, n: drawn.append((len(upto), n)) or draw(upto, n)
    for a in range(0, len(target), 1000):
        trainer.step(target[a : a + 1000], context[a : a + 1000])
    assert {n for _, n in drawn} == {lm.NOISE, lm.CLASS_NOISE} and len(drawn) == 400
    model.params.update(trainer.p)
    for k in (0, 1):
        p = np.exp(lm.log_probs(model, np.arange(len(model.noise)), np.full((len(model.noise), lm.CONTEXT), k)).astype(np.float64))
        assert p.sum() == pytest.approx(1, abs=1e-4) and p[k * 5 + 5 : k * 5 + 10].sum() > 0.9
        assert p[k * 5 + 5 : k * 5 + 10] == pytest.approx(np.full(5, 0.2), abs=0.06)


def test_noise_follows_the_shares():
    words = pd.DataFrame({"h": np.arange(50), "cls": np.zeros(50, int), "c": np.arange(50) ** 2 + 10})
    model = lm.first_model(words, np.bincount(words["cls"], weights=words["c"], minlength=lm.CLASSES), 50 + lm.CLASSES + 1)
    trainer = lm.Trainer(model, 2)
    got = np.bincount(trainer.drawn(trainer.upto, 400_000), minlength=len(model.noise)) / 400_000
    assert got == pytest.approx(model.noise, abs=0.004)


def test_words_beyond_the_commonest_have_contexts(spark):
    """400 common words without order, then 300 pairs of rarer words: their order counts although none is among the commonest."""
    r = random.Random(4)
    common, pairs = [f"common{i}q" for i in range(400)], [(f"first{i}q", f"second{i}q") for i in range(300)]
    texts = []
    for _ in range(1_200):
        some = [w for p in r.sample(pairs, 25) for w in p]
        texts.append(" ".join(r.choices(common, k=150) + some))
    ordered = [" ".join(w for p in r.sample(pairs, 40) for w in p) for _ in range(20)]
    mixed = []
    for text in ordered:
        words = text.split()
        seconds = words[1::2]
        mixed.append(" ".join(w for p in zip(words[::2], seconds[1:] + seconds[:1]) for w in p))
    rows = [(i, t, k) for i, (t, k) in enumerate([(t, "train") for t in texts] + [(t, "ordered") for t in ordered] + [(t, "mixed") for t in mixed])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(2)
    kinds = {i: k for i, _, k in rows}
    got = lm.score(docs, F.col("kind") != "train").where("held_out").toPandas()
    per = got.assign(kind=got["id"].map(kinds)).groupby("kind")["score"].mean() / 81
    assert per["ordered"] > per["mixed"] + 0.1
