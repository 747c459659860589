"""The factorization machine against a plain version, and that against Spark's."""

import random

import numpy as np
import pytest
from pyspark.ml.base import Estimator
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import FMRegressor

import __spark_entry__ as entry
from slatewise.operators import factorization as M


def _plain(x, y, bias, w, f, rounds, rate, reg):
    """Whole-batch AdamW on dense rows; x: rows x features, f: features x rank."""
    theta = np.concatenate([[bias], w, f.ravel()])
    m, v, d = np.zeros_like(theta), np.zeros_like(theta), len(w)
    for t in range(1, rounds + 1):
        bias, w, f = theta[0], theta[1 : d + 1], theta[d + 1 :].reshape(f.shape)
        s = x @ f
        e = 2 * (bias + x @ w + 0.5 * (s * s - (x * x) @ (f * f)).sum(axis=1) - y) / len(y)
        slope = x.T @ (e[:, None] * s) - f * ((x * x).T @ e)[:, None]
        g = np.concatenate([[e.sum()], x.T @ e, slope.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) - reg * theta
    return theta[0], theta[1 : d + 1], theta[d + 1 :].reshape(f.shape)


def _data():
    r = random.Random(3)
    genres = [(i, g) for i in range(14) for g in r.sample("abcdef", r.randint(1, 4))] + [(13, "only"), (1, "a")]
    rows = [(u, i, r.randint(1, 10) / 2) for u in range(20) for i in r.sample(range(13), r.randint(1, 8))]
    return rows, genres


def _dense(rows, genres, users, items, kinds):
    lists = {i: {g for j, g in genres if j == i and g in kinds} for i, _ in genres}
    x = np.zeros((len(rows), len(users) + len(items) + len(kinds)))
    for n, (u, i) in enumerate(r[:2] for r in rows):
        x[n, users.index(u if u in users else None)] = 1
        x[n, len(users) + items.index(i if i in items else None)] = 1
        for g in lists[i]:
            x[n, len(users) + len(items) + kinds.index(g)] = 1 / len(lists[i])
    return x


def _parameters(machine):
    tables = [sorted(((r.id, list(r.theta)) for r in t.collect()), key=lambda r: (r[0] is None, r[0])) for t in (machine.users, machine.items, machine.genres)]
    theta = np.array([r[1] for t in tables for r in t])
    return [[r[0] for r in t] for t in tables], theta[:, 0], theta[:, 1:]


@pytest.mark.parametrize("cells", [2_000_000, 3])
def test_fm_fits_as_a_plain_one(spark, monkeypatch, cells):
    monkeypatch.setattr(M, "CELL_RATINGS", cells)  # the second: 6 blocks a side
    rows, genres = _data()
    ratings, kinds = spark.createDataFrame(rows, "user_id long, item_id long, rating double"), spark.createDataFrame(genres, "item_id long, genre string")
    options = {"rank": 3, "rate": 0.02, "reg": 0.03, "std": 0.1}
    ids, w, f = _parameters(M.fit_fm(ratings, kinds, iterations=0, **options))
    assert not w.any() and 0.05 < f.std() < 0.2 and len(np.unique(f)) == f.size
    x = _dense(rows, genres, *ids)
    bias, w, f = _plain(x, np.array([r[2] for r in rows]), 0.0, w, f, 4, 0.02, 0.03)
    machine = M.fit_fm(ratings, kinds, iterations=4, **options)
    got_ids, got_w, got_f = _parameters(machine)
    assert got_ids == ids and ids[0][-1] is None and ids[1][-1] is None and "only" not in ids[2]
    assert abs(machine.bias - bias) < 1e-9 and np.allclose(got_w, w, atol=1e-9) and np.allclose(got_f, f, atol=1e-9)
    # pairs of unknown users and items, one whose genres are partly unknown, and an item without genres
    asked = [(0, 3), (99, 4), (2, 13), (98, 13), (1, 50)]
    out = {(r.user_id, r.item_id): r.pred for r in M.predict_fm(machine, spark.createDataFrame(asked, "user_id long, item_id long"), kinds, low=-9.0, high=9.0).collect()}
    x = _dense(asked[:4], genres, *ids)
    s = x @ f
    want = bias + x @ w + 0.5 * (s * s - (x * x) @ (f * f)).sum(axis=1)
    assert out.keys() == set(asked[:4]) and all(abs(out[a] - b) < 1e-9 for a, b in zip(asked, want, strict=False))


def test_the_plain_one_is_sparks(spark):
    rows, genres = _data()
    ids = [[*range(20), None], [*range(13), None], sorted({g for _, g in genres} - {"only"})]
    x, y = _dense(rows, genres, *ids), np.array([r[2] for r in rows])
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y, strict=True)], ["rating", "features"])

    def fitted(rounds):
        m = FMRegressor(labelCol="rating", factorSize=3, stepSize=0.02, regParam=0.03, maxIter=rounds, initStd=0.1, seed=1).fit(df)
        return m.intercept, m.linear.toArray(), m.factors.toArray()

    start, end = fitted(0), fitted(4)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(_plain(x, y, *start, 4, 0.02, 0.03), end, strict=True))


def test_no_vector_of_all_parameters_on_the_driver(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("an estimator whose model the driver holds")

    monkeypatch.setattr(Estimator, "fit", refuse)
    out = entry.queries()["factorization_machine"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["user_id", "item_id", "pred"] and out.filter("pred between 0.5 and 5").count() == out.count() > 0
