import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm.soft_mixing import TARGETS, apply_mix, fit_rates, mix, rate_after

DOCS = "doc_id long, text string, quality int, _n string"


def corpus(spark):
    rng = random.Random(6)
    good, low, toxic = [f"g{k}" for k in range(200)], [f"l{k}" for k in range(30)], ["moron", "clown"]
    docs, labels = [], []
    for k in range(900):
        kind = rng.choices("glt", (6, 3, 1))[0]
        words = rng.choices(good + low[:5], k=rng.randint(20, 80))
        if kind == "l":
            words = rng.choices(low + good[:20], k=rng.randint(20, 80))
        if kind == "t":
            words += toxic * 2
        docs.append((k, " ".join(words), 0, kind))
        if k % 2:
            labels.append((k, 0 if kind == "l" else 1, int(kind == "t"), "x"))
    docs += [(2000, None, 0, ""), (2001, "", 0, ""), (3, docs[3][1], 0, docs[3][3]), (None, "g1 g2 g3", 0, "g"),
             (2002, "g7 " * 20_000, 0, "g")]
    labels += [(None, 1, 0, "x"), (5, None, None, "x")]
    return (spark.createDataFrame(docs, DOCS).repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))


def test_targets_are_met_and_applied(spark):
    docs, labels = corpus(spark)
    mixed = mix(docs, labels, {"good": 0.8, "low": 0.2, "toxic": 0.0}, scale=0.7).cache()
    rows = mixed.collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    truth = {r.doc_id: r._n for r in docs.collect()}
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 2000 and r.doc_id % 2 == 0]
    assert np.mean([r.domain[0] == truth[r.doc_id] for r in held]) > 0.95
    total = sum(r.n_tokens for r in rows)
    by_domain = {d: sum(r.rate * r.n_tokens for r in rows if r.domain == d) for d in ("good", "low", "toxic")}
    assert abs(by_domain["low"] / (0.2 * 0.7 * total) - 1) < 0.1 and by_domain["toxic"] < 0.01 * total
    out = apply_mix(docs, mixed)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in rows)
    assert out.filter("_n = 't'").count() <= 0.05 * docs.filter("_n = 't'").count() + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_rates_solve_the_least_squares(spark, seed):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 500, 400)
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>")
    targets = np.array([0.7, 0.25, 0.05]) * n.sum()
    steps, totals = fit_rates(soft, targets, tolerance=1e-4)
    rates = np.ones(400)
    for step in steps:  # the same steps in numpy
        rates = np.maximum(0, rates - p @ step)
    assert np.allclose((rates * n) @ p, totals, rtol=1e-9)
    assert np.abs(totals - targets).max() <= 2e-3 * n.sum()
    assert soft.select(F.min(rate_after(steps))).first()[0] >= 0


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark)
    assert {(r.rate, r.copies) for r in mix(docs, labels.limit(0)).collect()} == {(1.0, 1)}
    assert mix(docs.limit(0), labels).count() == 0


def test_the_registered_targets_are_met(spark):
    docs, labels = corpus(spark)
    rows = mix(docs, labels, scale=0.85).collect()
    total = sum(r.n_tokens for r in rows)
    assert {r.met for r in rows} == {True}
    for name, share in TARGETS.items():
        target, reached = next((r.target, r.reached) for r in rows if r.domain == name)
        assert target == pytest.approx(share * 0.85 * total) and abs(reached / target - 1) <= 0.01


def test_each_domain_is_measured_by_its_own_target(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.2, 0.1, 0.05], 2000)
    n = rng.integers(1, 500, 2000)
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>")
    targets = np.array([0.93, 0.06, 0.01]) * n.sum() * 0.85
    steps, totals = fit_rates(soft, targets)
    rates = np.ones(2000)
    for step in steps:
        rates = np.maximum(0, rates - p @ step)
    assert np.allclose((rates * n) @ p, totals, rtol=1e-9) and np.abs(totals / targets - 1).max() <= 0.01


def test_targets_out_of_reach_are_flagged(spark):
    """Every document is half good and half low: no rates bring nine parts of one to one of the other."""
    soft = spark.createDataFrame([(100, [0.5, 0.5]), (50, [0.5, 0.5])], "n_tokens long, posteriors array<double>")
    steps, totals = fit_rates(soft, np.array([0.9, 0.1]) * 150)
    assert totals[0] == pytest.approx(totals[1]) and np.abs(totals / (np.array([0.9, 0.1]) * 150) - 1).max() > 0.01
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.met for r in mix(docs, labels, {"good": 0.9, "low": 0.1}).collect()} == {False}
