"""Forecasters against plain loops, and the dating steps on micro-frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitgrid.operators import aggregates as A
from visitgrid.operators import features as FE
from visitgrid.operators import forecast as FC
from visitgrid.operators import joins as J
from visitgrid.operators import series as TS
from visitgrid.operators import significance as SG
from visitgrid.operators.sampling import walk_forward_folds

SERIES = {1: [5.0], 2: [3.0, 7.0], 11: [float(i % 4) for i in range(11)], 12: [0.0] * 11 + [4.0],
          30: [10 + i + 5 * np.sin(i * np.pi / 6) for i in range(30)], 5: [0.0, 0.0, 2.0, 0.0, 3.0]}


@pytest.fixture(scope="module")
def arrays(spark):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in SERIES.items()], "s int, ys array<double>")


def values(arrays, expr):
    return {r[0]: r[1] for r in arrays.select("s", expr).collect()}


def test_sma(arrays):
    got = values(arrays, TS.sma("ys", 4, 3))
    for k, ys in SERIES.items():
        h = list(ys)
        for _ in range(4):
            h.append(float(np.mean(h[-3:])))
        assert got[k] == pytest.approx(h[len(ys):])


def test_ses_and_croston(arrays):
    ses, cr, sba = (values(arrays, f("ys", 2)) for f in (TS.ses, TS.croston, TS.sba))
    for k, ys in SERIES.items():
        level = ys[0]
        for y in ys[1:]:
            level = 0.3 * y + 0.7 * level
        assert ses[k] == pytest.approx([level] * 2)
        if len(ys) < 2:
            want = np.mean(ys)
        else:
            nz = [y for y in ys if y > 0]
            q, a, since = (nz[0] if nz else 0.0), 1.0, 0
            for y in ys[1:]:
                since += 1
                if y > 0:
                    q, a, since = 0.1 * y + 0.9 * q, 0.1 * since + 0.9 * a, 0
            want = max(q / a, 0)
        assert cr[k] == pytest.approx([want] * 2)
        assert sba[k] == pytest.approx([want * 0.95] * 2)


def test_holt_winters(arrays):
    out = {r["s"]: r["fc"] for r in TS.holt_winters(arrays, ["s"], "ys", 12, grid=[(0.3, 0.2, 0.1)]).collect()}
    assert out[1] is None
    ys = SERIES[30]
    level, trend = np.mean(ys[:12]), (np.mean(ys[12:24]) - np.mean(ys[:12])) / 12
    season = [y - level for y in ys[:12]]
    for i, y in enumerate(ys[12:]):
        s = season[i % 12]
        new = 0.3 * (y - s) + 0.7 * (level + trend)
        trend = 0.2 * (new - level) + 0.8 * trend
        season[i % 12] = 0.1 * (y - new) + 0.9 * s
        level = new
    want = [max(level + (k + 1) * trend + season[(18 + k) % 12], 0) for k in range(12)]
    assert out[30] == pytest.approx(want)
    assert len(out[2]) == 12 and min(out[12]) >= 0


def test_benchmark_gate(spark):
    rows = [(s, dt.datetime(2000 + i // 12, i % 12 + 1, 1), float(i % 5 + 1)) for s, n in (("a", 11), ("b", 12), ("c", 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, month timestamp, y double")
    out = TS.ts_benchmark(df, ["s"]).collect()
    assert {r["s"] for r in out} == {"b", "c"}
    assert {r["n"] for r in out if r["s"] == "c"} == {6} and {r["n"] for r in out if r["s"] == "b"} == {3}
    fc = TS.forecast_best(df, ["s"], TS.ts_benchmark(df, ["s"]), h=2).where("s = 'c'").orderBy("month").collect()
    assert [r["month"] for r in fc] == [dt.datetime(2002, 7, 1), dt.datetime(2002, 8, 1)]


def test_demand_class_and_gaps(spark):
    rows = [("lumpy", i, 1 if i == 3 else 0) for i in range(6)] + [("smooth", i, 5) for i in range(6)]
    rows += [("inter", i, 4 if i % 3 == 0 else 0) for i in range(12)] + [("erratic", i, 1 if i % 2 else 50) for i in range(12)]
    df = spark.createDataFrame(rows, "s string, month int, n int")
    got = {r["s"]: r["demand_class"] for r in TS.demand_class(df, ["s"]).collect()}
    assert got == {"lumpy": "Lumpy", "smooth": "Smooth", "inter": "Intermittent", "erratic": "Erratic"}
    m = spark.createDataFrame([("2020-01-05", 1.0), ("2020-03-09", 3.0)], "d string, y double")
    m = m.withColumn("d", F.col("d").cast("timestamp"))
    assert A.monthly_series(m, "y", "d").count() == 2
    assert A.monthly_series(m, "y", "d", fill_gaps=True).count() == 3


def test_walk_forward(spark):
    df = spark.createDataFrame([(7,), (30,)], "n int")
    got = {}
    for r in walk_forward_folds(df.withColumn("s", F.col("n")), 3).collect():
        got.setdefault(r["s"], []).append((r["train_end"], r["test_end"]))
    assert got[30] == [(10, 15), (15, 20), (20, 25), (25, 30)]
    assert got[7] == [(5, 6), (6, 7)]


def test_nearest_month(spark):
    fc = spark.createDataFrame([("2020-01-01", 1.0), ("2020-05-01", 5.0)], "month string, value double")
    fc = fc.withColumn("month", F.col("month").cast("timestamp"))
    df = spark.createDataFrame([("2020-03-15",), (None,), ("2030-01-01",), ("2019-01-01",), ("2020-02-01",)], "d string")
    df = df.withColumn("d", F.col("d").cast("timestamp"))
    got = {str(r["d"])[:7]: r["ts_value"] for r in J.nearest_month_value(df, "d", fc).collect()}
    assert got == {"2020-03": 5.0, "None": 3.0, "2030-01": 5.0, "2019-01": 1.0, "2020-02": 1.0}


def test_visit_gaps_hot_key(spark):
    days = ["2020-01-01 00:00:00", "2020-01-01 12:00:00", "2020-01-01 12:00:00", "2020-01-05 06:00:00", "2023-01-01 00:00:00"]
    df = spark.createDataFrame([("h", d) for d in days] + [("x", days[0]), (None, days[0])], "k string, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    got = sorted(r["gap"] for r in A.visit_gaps(df, "k", "t").collect() if r["gap"] is not None)
    assert got == [0, 3, 1091]
    row = A.inter_visit_gap(df, "k", "t").first()
    assert (row["n"], row["median_days"]) == (1, 3.0)


def test_top_k_ties_and_penalties(spark):
    rows = [(1, "A", 0, 0.4), (1, "B", 1, 0.4), (1, "A, C", 2, 0.2)]
    df = spark.createDataFrame(rows, "e int, cls string, code int, p double")
    assert [r["cls"] for r in FC.top_k_classes(df, "e", 2).orderBy("visit_number").collect()] == ["B", "A"]
    t = FC.component_sets({"g": {"B"}}, F.lit("g"))
    got = [round(r[0], 3) for r in df.select(FC.affinity_penalty(F.col("p"), "cls", t)).collect()]
    assert got == [0.32, 0.4, 0.16]
    bad = FC.component_sets({"1": {"C"}}, F.lit("1"))
    got = [round(r[0], 3) for r in df.select(FC.mismatch_penalty(F.col("p"), "cls", bad)).collect()]
    assert got == [0.4, 0.4, 0.06]
    small = spark.createDataFrame([(0.0199,), (0.02,)], "p double")
    assert FC.min_probability(small).count() == 1


def test_k_per_entity_defaults(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "derivat string")
    means = spark.createDataFrame([("a", 2.1)], "derivat string, mean_visits double")
    for g, want in ((1.4, [3, 2, 2]), (None, [3, 1, 1]), (float("nan"), [3, 1, 1])):
        assert [r["k"] for r in FC.k_per_entity(df, "derivat", means, g).collect()] == want


def test_duration_blend_chain(spark):
    df = spark.createDataFrame([(10.0, 20.0, 5.0), (10.0, None, 5.0)], "m double, t double, ts double")
    def run(*a, **k):
        return [round(r[0], 6) for r in df.select(FC.duration_blend(*a, **k)).collect()]
    assert run("m", "t", 7.0) == [17.0, 7.9]
    assert run("m", "t", 7.0, "ts") == [13.4, 7.03]
    assert run(None, "t", 7.0) == [20.0, 7.0]
    assert run("m", None, 7.0) == [10.0, 10.0] and run(None, None, 7.0) == [7.0, 7.0]


def test_horizon(spark):
    rows = [("2020-05-31",), ("2020-06-01",), ("2022-06-30",), ("2022-07-01",)]
    df = spark.createDataFrame(rows, "d string").select(F.col("d").cast("timestamp").alias("estimated_start"))
    assert FC.horizon_filter(df, "2020-06-15 00:00:00").count() == 2


def test_rare_remap(spark):
    rows = [("A",)] * 80 + [("B",)] * 60 + [("A, B",)] * 3 + [("C, A",)] * 2 + [("A, B, D",)] * 55
    df = spark.createDataFrame(rows, "cls string")
    n = {r["cls"]: r["count"] for r in FE.standalone_rare_remap(df, "cls").groupBy("cls").count().collect()}
    assert n == {"A": 80, "B": 63, "C": 2, "A, B, D": 55}


def test_binomial_p(spark):
    from math import comb
    rows = [(0, 0), (1, 0), (5, 5), (3, 17), (30, 72), (400, 700)]
    df = spark.createDataFrame(rows, "b long, c long")
    got = [r[0] for r in df.select(SG.binomial_p(F.col("b"), F.col("c"))).collect()]
    for (b, c), p in zip(rows, got):
        n, m = b + c, min(b, c)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, k) for k in range(m + 1)) / 2 ** n)
        assert p == pytest.approx(want, rel=1e-9)
    z = spark.createDataFrame([(1.96,), (0.0,)], "z double")
    assert [round(r[0], 5) for r in z.select(SG.normal_tail(F.col("z"))).collect()] == [0.05, 1.0]


def test_backtest_totals(spark):
    a = spark.createDataFrame([("A", 10), ("B", 4)], "type string, count_actual long")
    p = spark.createDataFrame([("A", 15), ("C", 2)], "type string, count_predicted long")
    e = spark.createDataFrame([("A", 12.5), ("C", 1.2)], "type string, expected double")
    c = FC.backtest_counts(a, p, e)
    rows = {r["type"]: r for r in c.collect()}
    assert rows["A"]["pct_diff"] == 50.0 and rows["A"]["count_expected"] == 12
    assert rows["C"]["pct_diff"] is None and rows["B"]["pct_diff"] == -100.0
    assert (rows["TOTAL"]["count_actual"], rows["TOTAL"]["count_predicted"]) == (14, 17)
    f = {r["type"]: r["factor"] for r in FC.calibration_factors(c).collect()}
    assert f == {"A": 0.667, "B": 1.0, "C": 0.0}
