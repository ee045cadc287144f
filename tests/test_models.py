"""Trained models beat the majority floor, twice alike; weights, folds and permutations by hand."""

import random

import pytest
from pyspark.sql import functions as F

from visitgrid.operators import evaluate as E
from visitgrid.operators import models as M

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        a, b = rng.random(), rng.random()
        rows.append((i, a, b, int(a + 0.3 * b + 0.2 * rng.random() > 1.0)))
    return spark.createDataFrame(rows, "id long, a double, b double, y int").cache()


@pytest.mark.parametrize("kind", ["logreg", "rf", "gbt"])
def test_fits_beat_the_floor(table, kind):
    train, test = table.where("id % 4 > 0"), table.where("id % 4 = 0")
    floor = M.fit_majority(train, "y").first()["share"]

    def run():
        s = M.positive_score(M.fit_classifier(train, FEATURES, "y", kind), test, "p")
        return [(r["y"], round(r["p"], 9)) for r in s.orderBy("id").collect()]

    one = run()
    assert sum((p >= 0.5) == y for y, p in one) / len(one) > floor
    assert one == run()


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 990 + [(1,)] * 10, "y int")
    plain = {r["y"]: r["weight"] for r in M.class_weights(df, "y").collect()}
    assert plain[1] / plain[0] == pytest.approx(99)
    capped = {r["y"]: r["weight"] for r in M.class_weights(df, "y", cap=20).collect()}
    assert capped[1] / capped[0] == pytest.approx(20)
    w = M.with_class_weight(df, "y").groupBy("y").agg(F.avg("__w").alias("w")).collect()
    assert {r["y"]: r["w"] for r in w} == pytest.approx(plain)


def test_permuted_columns(spark):
    df = spark.range(101).select("id", F.col("id").alias("f"), (F.col("id") * 10).alias("g"))
    rows = M.permuted_columns(df, "id", ["f", "g"]).collect()
    assert sorted(r["__perm_f"] for r in rows) == list(range(101))
    assert sorted(r["__perm_g"] for r in rows) == [10 * k for k in range(101)]
    step = {r["id"]: r["__perm_f"] for r in rows}
    assert len(set(step.values())) == 101 and all(k != v for k, v in step.items())
    # one cycle over all rows, and the second feature goes two places along it
    assert all(r["__perm_g"] == 10 * step[step[r["id"]]] for r in rows)
    seen, x = set(), 0
    while x not in seen:
        seen.add(x)
        x = step[x]
    assert len(seen) == 101


def test_search_and_folds(table):
    found = M.hyperparameter_search(table, "id", FEATURES, "y", "logreg", trials=2, k=2)
    assert found.first()["score"] > 0.9 and M.tuned_or_default(found) and M.tuned_or_default(found, 1.1) == {}
    cv = M.cross_validate(table, "id", FEATURES, "y", kinds=("logreg",), k=3).first()
    assert cv["cv_auc_mean"] > 0.9 and cv["cv_auc_std"] < 0.1


def test_permutation_importance(table):
    m = M.fit_classifier(table, FEATURES, "y", "logreg")
    got = {r["feature"]: r["importance"] for r in M.permutation_importance(m, table, "id", FEATURES, "y").collect()}
    assert got["a"] > got["b"] > 0
    assert E.roc_auc(M.positive_score(m, table, "p"), "y", "p").first()["roc_auc"] > 0.9


def test_learning_curve_deals_its_folds_once(spark, monkeypatch):
    """Fits and scores read written folds: their plans deal none anew."""
    df = spark.range(300).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("a")).withColumn("y", (F.col("a") > 0.5).cast("int"))
    plans, fit = [], M.fit_classifier

    def watched(train, *args, **kw):
        plans.append(train._jdf.queryExecution().optimizedPlan().toString())
        return fit(train, *args, **kw)

    monkeypatch.setattr(M, "fit_classifier", watched)
    out = M.learning_curve(df, "id", ["a"], "y", k=2, shares=(0.5, 1.0)).collect()
    assert len(out) == 4 and len(plans) == 4
    assert not any("Window" in p or "Join" in p for p in plans)
