"""Regression evaluation on the day scale as tables."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitgrid.functions.core import cut, ratio
from visitgrid.operators import evaluate as E
from visitgrid.operators.aggregates import histogram
from visitgrid.plans.ordered import exact_quantiles, materialize, prefix_sums

# Day bins of the duration classes.
BIN_EDGES = (0, 7, 30, float("inf"))
BIN_LABELS = ("Short (<7d)", "Medium (7-30d)", "Long (>30d)")
OUTLIER_PCTS = (0, 1, 2, 5, 10)


def _metric_aggs(y: str, yhat: str) -> list[Column]:
    """Sums behind MAE, RMSE and R2. Errors are squared as they are; the spread of y uses
    the sample variance, which Spark merges without cancellation."""
    e = F.col(y) - F.col(yhat)
    return [F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
            F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("__sse"),
            (F.var_pop(y) * F.count(F.lit(1))).alias("__sst")]


def regression_metrics(df: DataFrame, y: str, yhat: str, keys=()) -> DataFrame:
    out = df.groupBy(*keys).agg(*_metric_aggs(y, yhat))
    r2 = F.lit(1.0) - ratio("__sse", "__sst")
    return out.withColumn("r2", r2).drop("__sse", "__sst")


def from_log(pred) -> Column:
    """Back from log1p to days, never negative."""
    return F.greatest(F.expm1(pred), F.lit(0.0))


def duration_bin(c) -> Column:
    return cut(c, BIN_EDGES, BIN_LABELS, right=False)


def duration_bins(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Actual and predicted counts per duration class."""
    side = F.array(
        F.struct(duration_bin(y).alias("bin"), F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(duration_bin(yhat).alias("bin"), F.lit(0).alias("a"), F.lit(1).alias("p")))
    return (df.select(F.inline(side)).where(F.col("bin").isNotNull()).groupBy("bin")
            .agg(F.sum("a").alias("n_actual"), F.sum("p").alias("n_predicted")))


def duration_bin_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    d = df.select(duration_bin(y).alias("a"), duration_bin(yhat).alias("p"))
    return E.multiclass_metrics(d, "a", "p")


def residual_stats(df: DataFrame, y: str, yhat: str, coverage=(0.1, 0.9)) -> DataFrame:
    """Residual median, spread and tails; bias-corrected MAE; coverage of the tail interval."""
    d = df.select(F.col(y).cast("double").alias("y"), F.col(yhat).cast("double").alias("p"))
    d = d.withColumn("r", F.col("y") - F.col("p"))
    q = exact_quantiles(d, [], "r", {"median": 0.5, "lo": coverage[0], "hi": coverage[1]}).first()
    med, lo, hi = (q["median"], q["lo"], q["hi"]) if q else (None, None, None)
    m = F.lit(med)
    corrected = F.when(F.abs(m) > 1.0, F.greatest(F.col("p") + m, F.lit(0.0))).otherwise(F.col("p"))
    inside = F.col("y").between(F.greatest(F.col("p") + F.lit(lo), F.lit(0.0)),
                                F.greatest(F.col("p") + F.lit(hi), F.lit(0.0)))
    return d.agg(F.stddev_pop("r").alias("std"), F.avg(F.abs("r")).alias("mae"),
                 F.avg(F.abs(F.col("y") - corrected)).alias("mae_corrected"),
                 F.avg(inside.cast("double")).alias("coverage_80")).select(
        m.alias("median"), "std", F.lit(lo).alias("p10"), F.lit(hi).alias("p90"), "mae",
        "mae_corrected", "coverage_80")


def error_by_type(test: DataFrame, train: DataFrame, cls: str, y: str, yhat: str,
                  top: int | None = None) -> DataFrame:
    """Train and test rows, MAE and median absolute error per type; optionally the worst ones."""
    d = test.withColumn("__e", F.abs(F.col(y) - F.col(yhat)))
    base = d.groupBy(cls).agg(F.count(F.lit(1)).alias("n_test"), F.avg("__e").alias("mae"))
    med = exact_quantiles(d, [cls], "__e", {"median_abs_error": 0.5})
    n = train.groupBy(cls).agg(F.count(F.lit(1)).alias("n_train"))
    out = base.join(med, cls).join(n, cls, "left").fillna({"n_train": 0})
    return out if top is None else out.orderBy(F.desc("mae"), F.asc(cls)).limit(top)


def outlier_impact(df: DataFrame, y: str, yhat: str, pcts=OUTLIER_PCTS) -> DataFrame:
    """Metrics after dropping the rows with the largest errors, per percentage; one pass."""
    d = df.select(F.col(y).cast("double").alias("y"), F.col(yhat).cast("double").alias("p"))
    d = d.withColumn("__e", F.abs(F.col("y") - F.col("p")))
    cuts = exact_quantiles(d, [], "__e", {f"c{p}": (100 - p) / 100 for p in pcts}).first()
    levels = F.array(*[F.struct(F.lit(p).cast("long").alias("excl_pct"), F.lit(cuts[f"c{p}"]).alias("c"))
                       for p in pcts])
    # each row counts for every level whose cut-off it stays under
    kept = d.select("y", "p", F.explode(F.filter(
        levels, lambda s: (F.col("__e") <= s["c"]) | (s["excl_pct"] == 0))).alias("s"))
    m = regression_metrics(kept.select("y", "p", F.col("s.excl_pct").alias("excl_pct")),
                           "y", "p", ["excl_pct"])
    return m.withColumnRenamed("n", "n_kept").where(F.col("n_kept") >= 2)


def min_support_regression(df: DataFrame, y: str, yhat: str, support="support",
                           thresholds=E.SUPPORT_THRESHOLDS) -> DataFrame:
    """Regression metrics on rows whose type has enough training rows, per threshold."""
    rows = df.select(y, yhat, F.explode(F.filter(
        F.array(*[F.lit(x).cast("long") for x in thresholds]),
        lambda x: x <= F.col(support))).alias("min_support"))
    m = regression_metrics(rows, y, yhat, ["min_support"])
    return m.withColumnRenamed("n", "n_test").where(F.col("n_test") >= 2)


def group_quantiles(train: DataFrame, test: DataFrame, cls: str, y: str,
                    probs: dict[str, float] | None = None) -> DataFrame:
    """Per-type empirical quantiles of the train target, with their coverage on test rows."""
    probs = probs or {"p50": 0.5, "p90": 0.9}
    q = materialize(exact_quantiles(train, [cls], y, probs))
    j = test.join(q, cls)
    cov = j.groupBy(cls).agg(F.count(F.lit(1)).alias("n_test"), *[
        F.avg((F.col(y) <= F.col(p)).cast("double")).alias(f"coverage_{p}") for p in probs])
    return q.join(cov, cls)


def breusch_pagan(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """LM test of residual variance against the fitted value: n times the squared correlation
    of squared residual and fit; p from the chi-square tail with one degree of freedom."""
    from visitgrid.operators.significance import normal_tail
    e = F.col(y) - F.col(yhat)
    one = df.agg(F.count(F.lit(1)).alias("n"), F.corr(e * e, F.col(yhat).cast("double")).alias("__c"))
    lm = F.col("n") * F.col("__c") * F.col("__c")
    return one.select("n", lm.alias("lm"), normal_tail(F.sqrt(lm)).alias("p_value"))


def residual_histogram(df: DataFrame, y: str, yhat: str, bins=30) -> DataFrame:
    return histogram(df.withColumn("__r", (F.col(y) - F.col(yhat)).cast("double")), "__r", bins)


@F.pandas_udf(T.DoubleType())
def _normal_quantile(p: pd.Series) -> pd.Series:
    inv = NormalDist().inv_cdf
    return p.map(inv)


def qq_points(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Distinct residuals in order against normal quantiles at their mid rank."""
    d = df.select((F.col(y) - F.col(yhat)).cast("double").alias("residual"))
    cells = d.where(F.col("residual").isNotNull()).groupBy("residual").agg(F.count(F.lit(1)).alias("n"))
    r = prefix_sums(cells, [], "residual", ["n"])
    mid = (F.col("cum_n") - F.col("n") / 2.0) / F.col("tot_n")
    return r.select("residual", "n", mid.alias("prob"), _normal_quantile(mid).alias("theoretical"))


def fitted_pair(df: DataFrame, y: str, a: str, b: str) -> tuple[list[float], float]:
    """(coefficients, intercept) of least squares on two columns, from one row of moments."""
    m = df.agg(*[F.covar_pop(x, z).alias(n) for n, (x, z) in {
        "aa": (a, a), "bb": (b, b), "ab": (a, b), "ay": (a, y), "by": (b, y)}.items()],
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate((a, b, y))]).first()
    det = m["aa"] * m["bb"] - m["ab"] ** 2
    ka, kb = (m["ay"] * m["bb"] - m["by"] * m["ab"]) / det, (m["by"] * m["aa"] - m["ay"] * m["ab"]) / det
    return [ka, kb], m["m2"] - ka * m["m0"] - kb * m["m1"]


def noise_stability(df: DataFrame, row_id: str, y: str, preds: list[str], coef: list[float],
                    intercept: float, sigmas=(0.01, 0.02, 0.05, 0.10)) -> DataFrame:
    """MAE change of a linear stack when its inputs get hashed normal noise of sigma * std."""
    from visitgrid.functions.core import md5_unit
    stds = df.agg(*[F.stddev_pop(c).alias(c) for c in preds]).first()

    def stacked(inputs):
        total = F.lit(float(intercept))
        for k, v in zip(coef, inputs):
            total = total + F.lit(float(k)) * v
        return F.abs(F.col(y) - from_log(total))

    s = F.explode(F.array(*[F.lit(x) for x in sigmas])).alias("sigma")
    rows = df.select("*", s)
    noisy = []
    for i, c in enumerate(preds):
        u = md5_unit(F.concat_ws("-", row_id, F.col("sigma"), F.lit(i)))
        v = md5_unit(F.concat_ws("-", row_id, F.col("sigma"), F.lit(i), F.lit("b")))
        normal = F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)
        noisy.append(F.col(c) + normal * F.col("sigma") * F.lit(max(float(stds[c] or 0.0), 1e-8)))
    return rows.groupBy("sigma").agg(
        F.avg(stacked([F.col(c) for c in preds])).alias("base_mae"),
        F.avg(stacked(noisy)).alias("noisy_mae")).withColumn(
        "delta_mae", F.col("noisy_mae") - F.col("base_mae"))
