"""Mixing: the fit against a plain solver, caps, posteriors on held-out rows, awkward tables."""

import numpy as np
from pyspark.sql import functions as F

from quaverlake.llm.mixing import fit_rates, mix, posteriors, shares

WORDS = {"sea": "wave harbour salt boat tide".split(), "hill": "stone sheep path wind cairn".split(), "town": "street tram market bell bridge".split()}


def texts(label, n, seed):
    r = np.random.default_rng(seed)
    return [" ".join(r.choice(WORDS[label], 30)) for _ in range(n)]


def test_fit_reaches_the_least_squares(spark):
    r = np.random.default_rng(7)
    n, k = 300, 3
    p = r.dirichlet([0.3] * k, n)
    tokens, cap = r.integers(1, 50, n), r.integers(1, 4, n)
    target = (np.array([0.5, 0.3, 0.2]) * tokens.sum()).tolist()
    df = spark.createDataFrame([(int(t), [float(x) for x in q], int(c)) for t, q, c in zip(tokens, p, cap)], "tokens bigint, p array<double>, cap int")
    _, fitted = fit_rates({}, df.withColumn("k", F.monotonically_increasing_id()), target)
    rate = np.array([x.rate for x in fitted.orderBy("k").collect()])
    a = (p * tokens[:, None]).T
    x = np.ones(n)
    for _ in range(20000):
        x = np.clip(x - 2e-5 * a.T @ (a @ x - target) / 10, 0, cap)
    assert np.all(rate >= 0) and np.all(rate <= cap)
    assert np.sum((a @ rate - target) ** 2) <= np.sum((a @ x - target) ** 2) + 1e-4 * tokens.sum() ** 2


def test_rows_of_a_known_domain_enter_as_one(spark):
    rows = [(i, 10, [1.0, 0.0] if i % 2 else [0.0, 1.0], 2) for i in range(20)]
    target = [150.0, 60.0]
    _, each = fit_rates({}, spark.createDataFrame(rows, "k bigint, tokens bigint, p array<double>, cap int"), target)
    of, _ = fit_rates({(0, 2): 100, (1, 2): 100}, spark.createDataFrame([], "k bigint, tokens bigint, p array<double>, cap int"), target)
    got = {tuple(r.p): r.rate for r in each.collect()}
    assert abs(got[1.0, 0.0] - of[0, 2]) < 1e-9 and abs(got[0.0, 1.0] - of[1, 2]) < 1e-9 and abs(of[0, 2] - 1.5) < 1e-4


def test_posteriors_on_held_out_rows(spark):
    train = [(t, float(i)) for i, s in enumerate(WORDS) for t in texts(s, 40, i)]
    test = [(t, i) for i, s in enumerate(WORDS) for t in texts(s, 30, 100 + i)]
    out = posteriors(spark.createDataFrame(train, "t string, label double"), spark.createDataFrame(test, "t string, truth int"), "t", "label").collect()
    assert np.mean([int(np.argmax(r.p)) == r.truth for r in out]) > 0.95


def test_mix(spark):
    rows = [(i, t, s) for j, s in enumerate(WORDS) for i, t in enumerate(texts(s, 60 if s == "sea" else 6, j), 100 * j)]
    rows += [(900, texts("sea", 1, 5)[0], None), (901, None, "sea"), (902, "", "hill"), (903, texts("hill", 1, 6)[0], "elsewhere")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1.0 as rate", "2 as tokens")
    targets = spark.createDataFrame([("sea", 0.5, 1), ("hill", 0.2, 4), ("town", 0.25, 2), ("moon", 0.05, 3)], "source string, target_share double, max_repeats int")
    m = mix(docs, "doc_id", "text", "source", targets)
    got = {r.doc_id: r for r in m.collect()}
    assert len(got) == len(rows)
    assert got[900].domain == "sea" and got[903].domain == "hill"
    assert got[901].tokens == 0 and got[902].tokens == 0
    assert all(0 <= r.copies <= {"sea": 1, "hill": 4, "town": 2, None: 1}[r.domain] for r in got.values())
    assert all(r.rate == 2.0 for r in got.values() if r.domain == "town")  # a capped domain
    s = {r.source: r for r in shares(m, targets).collect()}
    assert s["moon"].mixed_tokens == 0 and abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    assert abs(s["hill"].share_of_all - 0.2) < 0.1
    assert mix(docs.limit(0), "doc_id", "text", "source", targets).count() == 0
