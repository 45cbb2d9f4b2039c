"""One solver for all classes and penalties against a dense one for each; term counts against plain ones."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.operators import features, linear

ROWS, SIZE, CLASSES, GRID = 240, 60, 8, (0.1, 1.0, 10.0)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = (rng.random((ROWS, SIZE)) < 0.1) * rng.random((ROWS, SIZE))
    x[5] = 0  # a row without any term
    y = x @ rng.normal(0, 4, (SIZE, CLASSES)) + rng.logistic(0, 1, (ROWS, CLASSES)) > 1
    y[:, 6], y[:, 7] = False, True
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    listed = [(i, [int(k) for k in np.flatnonzero(y[i])], [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] > 0]]) for i in range(ROWS)]
    return spark.createDataFrame(listed, "row_id long, labels array<int>, ids array<int>, values array<double>").repartition(3).cache()


def dense(x, y, c, penalize=True):
    y = np.where(y, 1.0, -1.0)
    design, n, pos = np.column_stack([x, np.ones(len(x))]), len(y), (y > 0).sum()
    a = c * np.where(y > 0, n / (2 * pos), n / (2 * (n - pos)))
    ridge = np.diag([1.0] * x.shape[1] + [float(penalize)])
    w = np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(y * (design @ w)))
        w -= np.linalg.solve(ridge + (design * (a * p * (1 - p))[:, None]).T @ design, ridge @ w - design.T @ (a * y * p))
    return w


def test_all_columns_are_those_of_a_dense_solver(data, rows):
    x, y = data
    model = linear.fit_linear(rows, SIZE, list(range(CLASSES)), GRID)
    for k in range(6):
        for c in GRID:
            assert abs(model.column(k, c) - dense(x, y[:, k], c)).max() < 1e-4
    assert not model.weights[:, 6 * len(GRID) :].any()  # classes that no row or all rows have
    one = linear.fit_linear(rows, SIZE, [2], GRID)
    assert model.passes <= 1.5 * one.passes  # whatever the number of classes
    logits = {(r["row_id"], r["c"], r["cls"]): (r["logit"], r["y"]) for r in linear.linear_logits(model, rows).collect()}
    assert len(logits) == ROWS * CLASSES * len(GRID)
    want = np.column_stack([x, np.ones(ROWS)]) @ model.weights
    assert all(abs(want[i, k * len(GRID) + GRID.index(c)] - z) < 1e-9 and bool(t) == y[i, k] for (i, c, k), (z, t) in logits.items())


def test_intercept_without_penalty_and_matrices_in_parts(data, rows):
    x, y = data
    model = linear.fit_linear(rows, SIZE, [0, 3], (1.0,), penalize_intercept=False, cells=SIZE + 1)
    assert all(abs(model.column(k, 1.0) - dense(x, y[:, k], 1.0, False)).max() < 1e-4 for k in (0, 3))


def test_choice_of_c(spark, data, rows):
    fit = linear.run_linear(rows, rows, rows.where("row_id < 9"), SIZE, [0, 1, 6], spark.createDataFrame([(0,), (1,)], "cls int"), GRID)
    assert fit["c"] == 10.0 and 0.9 < fit["val_macro_ap"] <= 1 and fit["test"].count() == 27 and fit["train"].count() == 3 * ROWS


def test_without_rows(rows):
    model = linear.fit_linear(rows.limit(0), SIZE, [0, 1], GRID)
    assert not model.weights.any()
    assert linear.linear_logits(model, rows.limit(0)).collect() == []


def test_sparse_rows(spark):
    rows = spark.createDataFrame([(1, [0]), (2, [])], "row_id long, labels array<int>")
    weights = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.25), (1, "lost", 1.0)], "row_id long, term string, weight double")
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "term string, id int")
    assert sorted(map(tuple, linear.sparse_rows(rows, weights, ids).collect())) == [(1, [0], [0, 1], [0.25, 0.5]), (2, [], [], [])]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_term_counts(spark, monkeypatch, most):
    texts = ["a b a b a", "", None, "x", "é b\na b é", "a b a b a", "lone " * 300]
    monkeypatch.setattr(features, "TOKENS", 8)
    got = {(r["row_id"], r["term"]): r["tf"] for r in features.term_counts(spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").repartition(2), most=most).collect()}
    want = Counter()
    for i, t in enumerate(texts):
        w = (t or "").split()
        want.update((i, " ".join(w[j : j + k])) for k in range(1, most + 1) for j in range(len(w) - k + 1))
    assert got == want
    assert features.term_counts(spark.createDataFrame([], "row_id long, text string"), most=most).agg(F.count("*")).first()[0] == 0


def test_tfidf_rows_are_the_weights_by_number_without_shuffled_rows(spark):
    words = ["a", "b1", "_c", "(", "{", "É", "longer", "0"]
    rng = np.random.default_rng(5)
    texts = [(i, None if i == 3 else " ".join(rng.choice(words, int(rng.integers(0, 30))))) for i in range(60)]
    docs = spark.createDataFrame(texts, "row_id long, text string").repartition(3)
    weights = features.tfidf(docs, docs.where("row_id % 5 > 1"), max_features=40).cache()
    ids = features.term_ids(weights)
    want = {r["row_id"]: (r["ids"], r["values"]) for r in linear.sparse_rows(docs.select("row_id"), weights, ids).collect()}
    rows, size = features.tfidf_rows(docs, F.expr("row_id % 5 > 1"), max_features=40)
    got = {r["row_id"]: (r["ids"], r["values"]) for r in rows.collect()}
    assert size == ids.count() == 40 and got.keys() == want.keys() and got[3] == ([], [])
    for i, (at, values) in want.items():
        assert got[i][0] == at and np.allclose(got[i][1], values, rtol=1e-12, atol=0)
    none, size = features.tfidf_rows(docs.where("false"), F.lit(True))
    assert size == 0 and none.count() == 0


def test_a_full_step_brings_its_gradient(rows, monkeypatch):
    asked = []
    gradient = linear._Fit.gradient
    monkeypatch.setattr(linear._Fit, "gradient", lambda self, w, cols: asked.append(w.any()) or gradient(self, w, cols))
    linear.fit_linear(rows, SIZE, [2], (1.0,))
    assert asked == [False]  # only that of the start
