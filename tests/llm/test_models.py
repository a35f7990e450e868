"""The classifier chain and the quality sketches against plain recomputation."""

import math
import os
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerwire.llm import quality, queries, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    data = []
    for i in range(500):
        bad, poor = i % 5 == 0, i % 3 == 0
        text = [f"w{r.randrange(300)}" for _ in range(30)] + ["scoundrel"] * bad + ["cheap", "cheap"] * poor
        r.shuffle(text)
        data.append((i, " ".join(text) if i % 50 else None, int(bad), int(not poor)))
    data += [(600, "long " * 50_000 + "scoundrel", 0, 1), (601, "", 0, 1), (602, data[1][1], 1, 0)]
    return spark.createDataFrame(data, "doc_id long, text string, toxic int, quality int").repartition(3)


def numbers(text):
    import re
    return {w for w in re.split(r"[\W_]+", (text or "").lower()) if w}


def test_chain_scores_by_brute_force(spark, corpus):
    models = toxicity.train(corpus, corpus.select("doc_id", "toxic", "quality"), queries.categories())
    assert len(models) == 2 and models[1].before.shape == (1,)
    got = toxicity.score(corpus, models).select("row.doc_id", "row.text", "p").collect()
    every = sorted(set().union(*(numbers(r.text) for r in got)))
    place = dict(spark.createDataFrame([(w,) for w in every], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(1 << toxicity.BITS))).collect())
    assert len(got) == 503
    for r in got:
        ids = {place[w] for w in numbers(r.text)}
        p = []
        for m in models:
            z = m.bias + sum(float(m.weights[k]) for k in ids) + sum(b * x for b, x in zip(m.before, p))
            p.append(1 / (1 + math.exp(-z)))
        assert np.allclose(r.p, p, atol=1e-5)


def test_chain_is_fitted_in_a_task(spark, corpus, monkeypatch):
    labels = corpus.select("doc_id", "toxic", "quality")
    models = toxicity.train(corpus, labels, queries.categories())
    driver, fit = os.getpid(), toxicity.fit_chain

    def elsewhere(*args):
        assert os.getpid() != driver, "the rows came to the driver"
        return fit(*args)
    monkeypatch.setattr(toxicity, "fit_chain", elsewhere)
    again = toxicity.train(corpus, labels, queries.categories())
    for a, b in zip(models, again, strict=True):
        assert np.array_equal(a.weights, b.weights) and np.array_equal(a.before, b.before) and a.bias == b.bias
    # what travels is the weights that are not 0
    sent = pickle.dumps(models)
    assert len(sent) < 100_000 and models[0].weights.any()
    for a, b in zip(models, pickle.loads(sent), strict=True):
        assert a.weights.dtype == b.weights.dtype and np.array_equal(a.weights, b.weights) and np.array_equal(a.before, b.before) and a.bias == b.bias


def test_chain_learns_from_predictions_out_of_fold():
    rng = np.random.default_rng(1)
    n, words = 400, 60
    lists = [np.unique(rng.integers(0, words, 12)) for _ in range(n)]
    rows = toxicity._rows(lists)
    first = np.array([float(3 in x) if rng.random() < 0.9 else rng.integers(0, 2) for x in lists])
    second = np.array([float(f and 7 in x) for f, x in zip(first, lists)])
    folds = rng.integers(0, 4, n)
    models = toxicity.fit_chain(rows, np.column_stack([first, second]), folds)
    outside = np.zeros(n)
    for f in range(4):
        rest, inside = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
        m = toxicity.fit_linear(rows.take(rest), np.zeros((len(rest), 0)), first[rest])
        for i in inside:
            outside[i] = 1 / (1 + math.exp(-(m.bias + sum(float(m.weights[k]) for k in lists[i]))))
    again = toxicity.fit_linear(rows, outside[:, None], second)
    assert np.allclose(models[1].weights, again.weights, atol=1e-5) and np.allclose(models[1].before, again.before, atol=1e-5)
    # a fit on its own predictions would be another model
    inside = toxicity.fit_linear(rows, models[0].score(rows, np.zeros((n, 0)))[:, None], second)
    assert not np.allclose(models[1].before, inside.before, atol=1e-3)


def test_linear_fit_is_at_the_minimum_of_its_loss():
    rng = np.random.default_rng(2)
    lists = [np.unique(rng.integers(0, 40, 10)) for _ in range(600)]
    y = np.array([float((1 in x) + (2 in x) - (3 in x) + rng.normal() > 0.5) for x in lists])
    earlier = rng.random((600, 1))
    m = toxicity.fit_linear(toxicity._rows(lists), earlier, y)
    kept = np.flatnonzero(m.weights)
    assert {1, 2} <= set(kept.tolist())
    x = np.array([[float(k in row) for k in kept] for row in lists])
    p = 1 / (1 + np.exp(-(x @ m.weights[kept] + earlier @ m.before + m.bias)))
    gradient = np.concatenate([x.T @ (p - y) + 0.2 * m.weights[kept], earlier.T @ (p - y) + 0.2 * m.before, [(p - y).sum()]])
    assert np.abs(gradient).max() < 1e-2


def test_thresholds_follow_exact_quantiles(spark):
    r = random.Random(4)
    data = []
    for i in range(3000):
        lang, source = r.choice([("en", "a"), ("en", "b"), ("de", None), (None, "a"), ("en", f"tiny{i % 40}")])
        words = ["".join(r.choice("abcdefgh") for _ in range(max(1, int(r.gauss(5, 1.5))))) for _ in range(r.randrange(12, 40))]
        words += ["#%"] * r.choice([0, 0, 1, 3])
        data.append((i, " ".join(words), lang, source))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(4)
    rows = quality._ratios(quality.measure(docs, "text", ("doc_id", "lang", "source")))
    limits = quality.thresholds(rows).collect()
    measured = rows.collect()
    of = {"own": lambda a, b: a == b, "lang": lambda a, b: a[0] == b[0], "all": lambda a, b: True}
    assert len(limits) == len({(x[2], x[3]) for x in data})
    for t in limits:
        group = (t.lang, t.source)
        for m, (both, slack) in quality.MEASURES.items():
            for level in of.values():   # the smallest level with enough rows
                values = sorted(x[m] for x in measured if level(group, (x.lang, x.source)))
                if len(values) >= quality.MIN_ROWS:
                    break
            q1, q3 = (values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75))
            # the sketch's quartiles are within one per cent of the exact ones
            reach = max(quality.SPREAD * (q3 - q1), slack)
            wide = 0.011 * (q3 + quality.SPREAD * (q3 + q1))
            assert abs(t[f"{m}_most"] - (q3 + reach)) <= wide + 1e-9, (group, m)
            if both:
                assert abs(t[f"{m}_least"] - (q1 - reach)) <= wide + 1e-9, (group, m)


def test_fit_is_stable_where_words_go_together():
    """Hundreds of words that occur together: leaving out a few rows must not
    change who is toxic."""
    rng = np.random.default_rng(5)
    topic = rng.integers(0, 4, 1500)
    lists = [np.unique(np.concatenate([rng.choice(np.arange(200 * t, 200 * t + 200), 120, replace=False), [900 + (t == 3)],
                                       [950] if t == 3 and rng.random() < 0.9 else []]).astype(int)) for t in topic]
    y = (topic == 3).astype(float)
    y[rng.choice(1500, 30, replace=False)] = 1 - y[rng.choice(1500, 30, replace=False)]
    whole = toxicity._rows(lists)
    none = np.zeros((1500, 0))
    full = toxicity.fit_linear(whole, none, y).score(whole, none)
    for seed in range(3):
        some = np.sort(np.random.default_rng(seed).choice(1500, 1470, replace=False))
        part = toxicity.fit_linear(whole.take(some), none[some], y[some]).score(whole, none)
        assert ((part >= 0.5) != (full >= 0.5)).mean() < 0.01 and np.abs(part - full).mean() < 0.02
    assert ((full >= 0.5) == (topic == 3)).mean() > 0.98
