import random

import numpy as np
from pyspark.sql import functions as F

from tabforge.llm import mixing

VOCAB = {"aa": ["ba", "be", "bi", "bo"], "bb": ["ko", "ka", "ke", "ki"], "cc": ["zu", "za", "ze", "ba"]}


def corpus(n=400):
    random.seed(6)
    rows = []
    for i in range(n):
        d = random.choices(list(VOCAB), [6, 3, 1])[0]
        rows.append((i, " ".join(random.choice(VOCAB[d]) for _ in range(random.randrange(5, 60))), d))
    return rows


def brute(tokens, p, goal, steps, least=0.0):
    r, start = np.ones(len(tokens)), tokens @ p
    for _ in range(steps):
        r = np.maximum(least, r - p @ (((r * tokens) @ p - goal) / start))
    return r


def test_rates_meet_targets_and_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for budget, least in ((None, 0.0), (5000.0, 0.0), (None, 1.0)):
        out, domains = mixing.mixture(docs, docs, {"aa": 0.4, "bb": 0.3, "cc": 0.3}, budget, least=least)
        got = out.select("doc_id", "n_tokens", "posterior", "rate", "copies").toPandas()
        tokens, p = got.n_tokens.to_numpy(float), np.stack(got.posterior)
        assert abs(p.sum(1) - 1).max() < 1e-9 and got.rate.min() >= least
        start = tokens @ p
        want = budget or (start / np.array([0.4, 0.3, 0.3])).max()
        goal = want * np.array([0.4, 0.3, 0.3])
        if not least:
            assert abs((got.rate.to_numpy() * tokens) @ p - goal).max() < 1e-3 * want
        assert any(abs(brute(tokens, p, goal, k, least) - got.rate.to_numpy()).max() < 1e-6 for k in range(mixing.STEPS + 1))
        assert ((got.copies - got.rate).abs() < 1).all()
    right = sum(domains.names[int(np.argmax(q))] == lang for q, (_, _, lang) in zip(got.sort_values("doc_id").posterior, rows, strict=True))
    assert right / len(rows) > 0.95


def test_edges(spark):
    rows = [(1, None, "aa", 5), (1, None, "aa", 5), (None, "ba be", None, 5), (3, "ko " * 50_000, "bb", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate int")
    out, _ = mixing.mixture(docs, docs, {"aa": 0.5, "bb": 0.5})
    assert out.count() == 4 and out.filter("rate IS NULL OR rate < 0 OR copies IS NULL").count() == 0
    none, d = mixing.mixture(docs, docs.limit(0), {"aa": 0.5, "bb": 0.5})
    assert d.names == [] and none.filter("rate != 1 OR copies != 1").count() == 0
    assert mixing.mixture(docs.limit(0), docs, {"aa": 1.0})[0].count() == 0
    assert out.select(F.size("posterior").alias("k")).distinct().count() == 1
