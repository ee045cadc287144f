"""The trained forecast: fit, store, load, score, backtest and export on a small world with a known rule."""

import random

import pytest
from pyspark.sql import functions as F

from visitgrid import columns as C
from visitgrid.operators import bundle as B
from visitgrid.operators import forecast as FC
from visitgrid.operators import models as M
from visitgrid.sources.reuse import ResultStore

AS_OF = "2001-08-02 00:00:00"
SPEC = B.Spec("ent_id", "jk", ("derivat_clean", "bo_clean"), ("age",), binary_kinds=("logreg", "rf"), class_kinds=("rf",), duration_kinds=("ridge", "rf"))


@pytest.fixture(scope="module")
def world(spark):
    """Entities of derivat A come often and for package P, those of B seldom and for Q, for longer."""
    rng = random.Random(9)
    ents, visits = [], []
    for i in range(600):
        d = "A" if rng.random() < 0.5 else "B"
        came = rng.random() < (0.8 if d == "A" else 0.1)
        ents.append((i, f"k{i}", d, rng.choice("xyz"), rng.random() * 10, int(came), None if i % 9 else "2001-12-01 00:00:00"))
        for j in range(rng.randint(1, 2) if d == "A" else 1):
            pack = ("P" if rng.random() < 0.9 else "Q") if d == "A" else ("Q, R" if rng.random() < 0.8 else "P")
            start = 730_000 + rng.randrange(400) * 24 + j * 5000
            visits.append((f"k{i}", pack, start, start + 24 * (3 if d == "A" else 12)))
    ent = spark.createDataFrame(ents, "ent_id long, jk string, derivat_clean string, bo_clean string, age double, came_for_retrofit int, rueckgabe_soll string")
    ent = ent.withColumn("rueckgabe_soll", F.col("rueckgabe_soll").cast("timestamp")).cache()
    vis = spark.createDataFrame(visits, "jk string, umr_art string, s long, e long")
    at = lambda c: F.timestamp_seconds((F.col(c) - 730_000) * 3600 + F.unix_timestamp(F.lit("2000-01-01 00:00:00").cast("timestamp")))
    vis = vis.select("jk", "umr_art", at("s").alias("umr_start"), at("e").alias("umr_av")).cache()
    return ent, vis


@pytest.fixture(scope="module")
def fitted(spark, world, tmp_path_factory):
    store = ResultStore(spark, str(tmp_path_factory.mktemp("bundles")), *world)
    return B.fit_bundle(store, *world, SPEC), store


def test_models_learned_the_rule(fitted, world):
    b, _ = fitted
    rows, classes = B.expected_visits(b, world[0], 0.0)
    p = {r["derivat_clean"]: r["p"] for r in rows.groupBy("derivat_clean").agg(F.avg("prob_coming").alias("p")).collect()}
    assert p["A"] > 0.6 > 0.4 > p["B"] and rows.count() == 600
    top = classes.groupBy("derivat_clean", "cls").agg(F.avg("p").alias("p")).orderBy(F.desc("p")).collect()
    assert {(r["derivat_clean"], r["cls"]) for r in top[:2]} == {("A", "P"), ("B", "Q, R")}
    sums = classes.groupBy("ent_id").agg(F.sum("p").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)
    t = {(r["task"], r["model"]): r for r in b.champions.collect()}
    assert len(t) == 5 and sum(r["chosen"] for r in t.values()) == 3 and 0 < t["binary", "rf"]["threshold"] < 1


def test_encodings_come_from_train_rows(fitted, world):
    b, store = fitted
    train = store.table("split", lambda: None).where("split = 'train'")
    n = train.count()
    assert 420 < n < 540
    share = {r["value"]: r["share"] for r in b.frequencies.where("feature = 'derivat_clean'").collect()}
    assert share["A"] == pytest.approx(train.where("derivat_clean = 'A'").count() / n)


def test_second_run_loads(fitted, world, spark, monkeypatch):
    b, store = fitted

    def no_fit(*a, **k):
        raise AssertionError("fitted again")

    monkeypatch.setattr(M, "fit_classifier", no_fit)
    monkeypatch.setattr(M, "fit_regressor", no_fit)
    again = B.fit_bundle(ResultStore(spark, store.root, *world), *world, SPEC)
    assert again.classes == b.classes == ["P", "Q", "Q, R"]
    one, two = (B.expected_visits(x, world[0], 0.5)[1].orderBy("ent_id", "cls").collect() for x in (b, again))
    assert one == two


def test_backtest_reconciles(fitted, world):
    b, _ = fitted
    t = {r["type"]: r for r in B.run_backtest(b, *world).collect()}
    total = t.pop("TOTAL")
    for c in ("count_actual", "count_predicted", "count_expected", "diff", "exp_diff"):
        assert sum(r[c] for r in t.values()) == total[c]
    actual = {}
    for r in world[1].collect():
        for x in r["umr_art"].split(", "):
            actual[x] = actual.get(x, 0) + 1
    assert {k: r["count_actual"] for k, r in t.items()} == actual


def test_forecast_and_export(fitted, world):
    b, _ = fitted
    ent, vis = world
    factors = FC.calibration_factors(B.run_backtest(b, ent, vis))
    rows = B.run_forecast(b, ent, AS_OF, threshold=0.02, factors=factors).cache()
    got = rows.collect()
    unseen = {r["ent_id"] for r in ent.where("came_for_retrofit = 0").collect()}
    assert got and {r["ent_id"] for r in got} <= unseen
    assert len({(r["ent_id"], r["visit_number"], r["copy"]) for r in got}) == len(got)
    assert all(1 <= r["visit_number"] <= r["k"] and r["prob_coming"] >= 0.02 and C.MIN_TYPE_PROBABILITY <= r["p"] <= 1 for r in got)
    assert all("2001-08" <= str(r["estimated_month"])[:7] <= "2003-08" for r in got)
    days = {}
    for r in got:
        days.setdefault(r["cls"], []).append(r["predicted_duration_days"])
    assert sum(days["Q, R"]) / len(days["Q, R"]) > sum(days["P"]) / len(days["P"]) + 3
    out = B.export(b, vis, rows, ["umr_start", "umr_av", "umr_art"], AS_OF, threshold=0.02)
    new = out.where(F.col("forecast_binary_model").isNotNull()).collect()
    assert len(new) == len(got) and out.count() == len(got) + vis.count()
    names = {r["task"]: r["model"] for r in b.champions.where("chosen = 1").collect()}
    assert {(r["forecast_binary_model"], r["forecast_multiclass_model"], r["forecast_duration_model"], r["forecast_threshold"]) for r in new} == {
        (names["binary"], names["multiclass"], names["duration"], 0.02)}
    plain = B.run_forecast(b, ent, AS_OF, threshold=0.02)
    assert plain.where("copy <> 0 or calibration_weight <> 1").count() == 0 and plain.count() > 0
