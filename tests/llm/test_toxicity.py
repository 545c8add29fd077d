"""Held-out accuracy, and the chain's order."""

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import toxicity as T

CHAIN = lambda: [("junk", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)]


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = T.fit(docs, labels.where("doc_id % 2 = 0"), CHAIN())
    out = T.scored(docs, chain).join(labels.where("doc_id % 2 = 1"), "doc_id")
    by = {(r["toxic"], r["said"]): r["count"] for r in out.groupBy("toxic", (F.col("p_toxic") >= 0.5).alias("said")).count().collect()}
    caught, missed, wrong, right = by.get((1, True), 0), by.get((1, False), 0), by.get((0, True), 0), by.get((0, False), 0)
    assert caught / (caught + missed) > 0.85 and wrong / (wrong + right) < 0.005, by


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(1)
    n = 600
    x = rng.random((n, 20)) < 0.3
    rows, cols = np.nonzero(x)
    first = rng.random(n) < 0.5  # nothing to learn: only out-of-fold predictions show it
    labels = np.c_[first, first]
    chain = T.fit_chain(["a", "b"], {str(i): i for i in range(20)}, rows, cols, np.zeros((n, T.SHAPES)), labels, np.arange(n) % T.FOLDS)
    assert chain.weights[1][-2] < 3 and len(chain.weights[1]) == len(chain.weights[0]) + 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some idiot", "c"), (3, "x " * 5000, "d"), (3, "y", "e")], "doc_id long, text string, p string")
    none = spark.createDataFrame([(None, 1, None), (1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    chain = T.fit(docs, none, CHAIN())
    got = T.scored(docs, chain).collect()
    assert len(got) == 5 and all(r["p_toxic"] == 0.0 for r in got) and {r["p"] for r in got} == set("abcde")
    assert T.scored(docs.where("doc_id > 9"), T.fit(docs, none.where("doc_id > 9"), CHAIN())).count() == 0


def test_chain_against_a_plain_refit():
    """Weights and later inputs as by fitting each model and fold by itself; rows without a label are left out."""
    rng = np.random.default_rng(5)
    n, m = 400, 12
    x = (rng.random((n, m)) < 0.3).astype(float)
    shapes = rng.random((n, T.SHAPES))
    y = np.c_[x[:, 0] + x[:, 1] > 0, x[:, 2] * (x[:, 0] + 1) > 0].astype(int)
    y[rng.random(n) < 0.2, 0] = -1
    folds = np.arange(n) % T.FOLDS
    rows, cols = np.nonzero(x)
    chain = T.fit_chain(["a", "b"], {str(i): i for i in range(m)}, rows, cols, shapes, y, folds)

    def fit(features, truth):
        w, a, b = np.zeros(features.shape[1]), 0, 0
        for t in range(1, 301):
            err = 1 / (1 + np.exp(-features @ w)) - truth
            g = features.T @ err / len(truth)
            g[:-1] += 1e-5 * w[:-1]
            a, b = 0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g
            w = w - 0.2 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        return w

    say = lambda w, f: 1 / (1 + np.exp(-f @ w))
    first = np.c_[x, shapes, np.ones(n)]
    known = y[:, 0] >= 0
    w = fit(first[known], y[known, 0])
    assert np.allclose(chain.weights[0], w, atol=1e-6)
    said = say(w, first)
    for f in range(T.FOLDS):
        out = known & (folds == f)
        said[out] = say(fit(first[known & (folds != f)], y[known & (folds != f), 0]), first[out])
    assert np.allclose(chain.weights[1], fit(np.c_[x, shapes, said, np.ones(n)], y[:, 1]), atol=1e-6)


def test_null_labels_do_not_train(spark):
    """Rows without a label for a category count neither way: with them as negatives the word would not be chosen."""
    docs = spark.createDataFrame([(i, ("slur here" if i % 3 == 0 else "calm words") + f" n{i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1 if i % 3 == 0 and i < 90 else None if i % 3 == 0 else 0) for i in range(600)], "doc_id long, quality int, toxic int")
    chain = T.fit(docs, labels, CHAIN())
    got = {r["doc_id"]: r["p_toxic"] for r in T.scored(docs, chain).collect()}
    assert chain.weights[0] is None and min(got[i] for i in range(0, 600, 3)) > 0.9 and max(got[i] for i in range(600) if i % 3) < 0.1


def test_repeated_ids_keep_the_sample_bounded(spark, monkeypatch):
    seen = []
    fit = T.fit_chain
    monkeypatch.setattr(T, "fit_chain", lambda *a: seen.append(a) or fit(*a))
    docs = spark.createDataFrame([(i % 30, f"word{i}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] * 3, "doc_id long, quality int, toxic int")
    T.fit(docs, labels, CHAIN(), sample_size=20)
    assert len(seen[0][5]) == 20


def test_clashing_columns_and_ties(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x", 0.5), (1, "a", 5, "x", 0.5)], "doc_id long, text string, p int, `row` string, p_junk double")
    out = T.scored(docs, T.Chain(["junk", "toxic"], {}, [None, None], [set(), set()])).collect()
    assert [(r["p"], r["row"], r["p_junk"], r["p_toxic"]) for r in out] == [(5, "x", 0.0, 0.0)] * 2
