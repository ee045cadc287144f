"""Resampling inside folds, class stacks, calibration, quantile forests and lag regressions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitgrid.operators import lags as L
from visitgrid.operators import models as M
from visitgrid.operators import tuning as T

X = ["a", "b"]


@pytest.fixture(scope="module")
def rare(spark):
    """One row in eight is of class 1."""
    rng = random.Random(3)
    rows = []
    for i in range(800):
        y = int(i % 8 == 0)
        rows.append((i, rng.gauss(2.0 * y, 1), rng.gauss(-1.5 * y, 1), y))
    return spark.createDataFrame(rows, "id long, a double, b double, y int").cache()


@pytest.fixture(scope="module")
def three(spark):
    """Three classes, the second ring-shaped, so that a linear model misses what a forest finds."""
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        a, b = rng.uniform(-2, 2), rng.uniform(-2, 2)
        y = 0 if a * a + b * b < 1.2 else (1 if a + 0.5 * b > 0.2 * rng.gauss(0, 1) else 2)
        rows.append((i, a, b, y))
    return spark.createDataFrame(rows, "id long, a double, b double, y long").cache()


def test_no_synthetic_row_in_a_validation_fold(rare):
    tables = T.fold_tables(rare, "id", X, "y", (None, 0.5), k=3)
    real = {(round(r["a"], 12), round(r["b"], 12)): r["id"] for r in rare.collect()}
    seen = []
    for (fold, ratio), (train, valid) in tables.items():
        rows = valid.select("id", "y", *[F.col("features")]).collect()
        assert "synthetic" not in valid.columns and all(real[round(r["features"][0], 12), round(r["features"][1], 12)] == r["id"] for r in rows)
        held = {r["id"] for r in rows}
        by = {(r["synthetic"], r["y"]): r["n"] for r in train.groupBy("synthetic", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
        originals = {real[round(r["features"][0], 12), round(r["features"][1], 12)] for r in train.where("not synthetic").collect()}
        assert not held & originals and len(held) + len(originals) == 800
        if ratio is None:
            assert (True, 1) not in by
            seen += held
        else:
            assert by[True, 1] == int(by[False, 0] * ratio) - by[False, 1] and (True, 0) not in by
    assert sorted(seen) == list(range(800))


def test_search_over_parameters_and_ratio(rare):
    found = T.resampling_search(rare, "id", X, "y", "logreg", trials=3, k=2, parallelism=3).collect()
    assert [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True) and len(found) == 3
    params = [json.loads(r["params"]) for r in found]
    assert all(set(p) == {"ratio", "regParam", "elasticNetParam"} for p in params) and len({r["params"] for r in found}) == 3
    assert any(p["ratio"] for p in params) and all(p["ratio"] == r["ratio"] for p, r in zip(params, found))
    assert found[0]["score"] > 0.85
    again = T.resampling_search(rare, "id", X, "y", "logreg", trials=3, k=2, parallelism=1).collect()
    assert [(r["trial"], round(r["score"], 9)) for r in again] == [(r["trial"], round(r["score"], 9)) for r in found]


def test_tuned_or_default(rare):
    search = rare.sparkSession.createDataFrame([(0, '{"ratio": 0.5, "regParam": 0.01}', 0.9), (1, '{"ratio": null}', 0.4)],
                                               "trial int, params string, score double")
    m, params = T.fit_tuned(rare, "id", X, "y", search)
    assert params == {"ratio": 0.5, "regParam": 0.01} and m.stages[-1].getRegParam() == 0.01
    m, params = T.fit_tuned(rare, "id", X, "y", search, floor=0.95)
    assert params == {} and m.stages[-1].getRegParam() == 0.0


def test_multiclass_search(three):
    found = T.resampling_search(three, "id", X, "y", "rf", trials=2, k=2, metric="f1", ratios=(0.8,))
    assert found.first()["score"] > 0.8 and {r["ratio"] for r in found.collect()} == {0.8}


def test_class_stack_beats_its_best_base(three):
    train, test = three.where("id % 4 > 0"), three.where("id % 4 = 0")
    bases, meta = M.stack_classes(train, "id", X, "y", ["logreg", "rf"], k=3)
    got = M.stack_class_predict(bases, meta, test).agg(*[
        F.avg((F.col(c) == F.col("y")).cast("double")).alias(c) for c in ("prediction", "prediction_logreg", "prediction_rf")]).first()
    assert got["prediction"] >= max(got["prediction_logreg"], got["prediction_rf"]) > 0.6 and got["prediction"] > got["prediction_logreg"] + 0.1
    oof = M.out_of_fold_classes(train, "id", X, "y", ["logreg"], k=3)
    assert oof.count() == train.count() and {len(r["oof_logreg"]) for r in oof.collect()} == {3}


def test_sigmoid_maps(spark):
    """Newton's optimum against a plain gradient descent on the same smoothed targets."""
    rng = random.Random(5)
    rows = [(c, p, int(rng.random() < 1 / (1 + math.exp(-(6 * p - k))))) for k, c in ((3, "x"), (5, "y")) for p in (rng.random() for _ in range(400))]
    rows += [("z", 0.1, 0), ("z", 0.9, 1), ("w", 0.5, 1)]
    maps = {r["cls"]: (r["a"], r["b"]) for r in M.sigmoid_maps(spark.createDataFrame(rows, "cls string, p double, hit int"), "cls", "p", "hit").collect()}
    for c in "xyz":
        p = np.array([r[1] for r in rows if r[0] == c])
        y = np.array([r[2] for r in rows if r[0] == c])
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = maps[c]
        off = t - 1 / (1 + np.exp(-(a * p + b)))
        assert abs(off.sum()) < 1e-6 * len(p) and abs((off * p).sum()) < 1e-6 * len(p)
    assert all(map(math.isfinite, maps["w"]))


def test_calibrated_classes_sum_to_one(spark):
    rows = [(i, c, p) for i, ps in enumerate([(0.2, 0.5, 0.3), (0.0, 0.0, 1.0)]) for c, p in zip("xyz", ps)]
    maps = spark.createDataFrame([("x", 4.0, -2.0), ("y", 2.0, -1.0)], "cls string, a double, b double")
    out = M.calibrated_classes(spark.createDataFrame(rows, "id long, cls string, p double"), maps, "id")
    got = {(r["id"], r["cls"]): r["p"] for r in out.collect()}
    q = {"x": 1 / (1 + math.exp(-(4 * 0.2 - 2))), "y": 0.5, "z": 0.3}
    assert got[0, "x"] == pytest.approx(q["x"] / sum(q.values())) and sum(got[1, c] for c in "xyz") == pytest.approx(1)


def test_quantile_forest(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        x = rng.random()
        rows.append((i, x, rng.expovariate(1 / (1 + 9 * (x > 0.5)))))
    df = spark.createDataFrame(rows, "id long, a double, y double")
    q = M.quantile_forest(df.where("id % 3 > 0"), df.where("id % 3 = 0"), "id", ["a"], "y", {"p50": 0.5, "p90": 0.9}, numTrees=20)
    r = q.agg(F.avg((F.col("y") <= F.col("p50")).cast("double")).alias("c50"), F.avg((F.col("y") <= F.col("p90")).cast("double")).alias("c90"),
              F.avg(F.when(F.col("a") > 0.5, F.col("p50"))).alias("high"), F.avg(F.when(F.col("a") <= 0.5, F.col("p50"))).alias("low"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] == 1000 and 0.44 < r["c50"] < 0.56 and 0.86 < r["c90"] < 0.95
    assert r["high"] == pytest.approx(10 * math.log(2), rel=0.25) and r["low"] == pytest.approx(math.log(2), rel=0.25)


def test_fit_table_is_bounded_and_repeatable(rare):
    some = M.fit_table(rare, ["id", *X, "y"], 200)
    assert 140 < some.count() < 260 and M.fit_table(rare, X).count() == 800
    shuffled = M.fit_table(rare.orderBy(F.rand(1)), ["id", *X, "y"], 200)
    assert [tuple(r) for r in some.collect()] == [tuple(r) for r in shuffled.collect()]


@pytest.fixture(scope="module")
def months(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s in range(4):
        ys = 50 + 10 * np.sin(np.arange(40) / 2) + rng.normal(0, 3, 40) * (s + 1)
        rows += [(s, i, float(y)) for i, y in enumerate(ys[:40 if s else 11])]
    return spark.createDataFrame(rows, "s long, month int, y double").withColumn(
        "month", F.add_months(F.lit("2000-01-01").cast("date"), F.col("month")).cast("timestamp")), rows


@pytest.mark.parametrize("kind", L.KINDS)
def test_fits_by_their_conditions(kind):
    """Least squares and ridge by their normal equations, the lasso by its subgradient, on scaled columns."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * [1, 10, 0, 3]
    y = x @ [2.0, -0.3, 5, 0] + rng.normal(size=60)
    w, b = L.fitted(x, y, kind)
    span = np.where(np.ptp(x, axis=0) == 0, 1, np.ptp(x, axis=0))
    e = y - x @ w - b
    g = ((x - x.min(axis=0)) / span).T @ e - ((x - x.min(axis=0)) / span).mean(axis=0) * e.sum()
    v = w * span
    assert abs(e.mean()) < 1e-9
    if kind == "Lasso":
        n = len(y) * L.LASSO
        assert all(abs(gi - n * np.sign(vi)) < 1e-5 if abs(vi) > 1e-9 else abs(gi) <= n + 1e-5 for gi, vi in zip(g, v))
    else:
        assert np.allclose(g, L.RIDGE * v if kind == "Ridge" else 0, atol=1e-6)


def test_lag_benchmark(months):
    df, rows = months
    got = {(r["s"], r["model"]): r for r in L.lag_benchmark(df, ["s"]).collect()}
    assert {s for s, _ in got} == {0, 1, 2, 3} and len(got) == 12
    ys = np.array([y for s, _, y in rows if s == 2])
    x, y = L.lagged(ys, 6)
    assert x[0].tolist() == ys[5::-1].tolist() and y[0] == ys[6] and len(y) == 34
    folds = L.folds_of(34, 6)
    assert folds == [(11, 16), (16, 21), (21, 26), (26, 31), (31, 34)]
    maes = []
    for a, b in folds:
        w, b0 = L.fitted(x[:a], y[:a], "Ridge")
        maes.append(np.abs(y[a:b] - np.maximum(x[a:b] @ w + b0, 0)).mean())
    r = got[2, "Lag-Ridge"]
    assert r["folds"] == 5 and r["mae"] == pytest.approx(np.mean(maes)) and r["family"] == "ML on Lags"
    assert got[0, "Lag-Ridge"]["folds"] == len(L.folds_of(8, 3))


def test_lag_forecast(months):
    df, rows = months
    got = [r["value"] for r in L.lag_forecast(df.where("s = 2"), ["s"], 4).orderBy("month").collect()]
    ys = [y for s, _, y in rows if s == 2]
    w, b0 = L.fitted(*L.lagged(np.array(ys), 6), "Ridge")
    for v in got:
        want = max(float(np.dot(ys[:-7:-1], w) + b0), 0)
        assert v == pytest.approx(want)
        ys.append(want)
    assert L.lag_forecast(df.where("s = 9"), ["s"], 4).count() == 0
