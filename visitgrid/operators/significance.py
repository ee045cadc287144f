"""Paired tests, bootstrap intervals and model ranking."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgrid import columns as C
from visitgrid.functions.core import ratio
from visitgrid.operators import evaluate as E
from visitgrid.operators.replicates import bootstrap_metrics, class_cell_replicates
from visitgrid.operators.sampling import percentile_interval
from visitgrid.plans.ordered import materialize

def _stirling_error(n: float) -> float:
    """log(n!) minus Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    x = 1 / (n * n)
    return (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x / 1680))) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation near x = mean."""
    e = (x - mean) / mean
    if abs(e) > 0.1:
        return x * math.log(x / mean) + mean - x
    # the series of (1 + e) log(1 + e) - e
    term, total, k = e * e, 0.0, 2
    while True:
        new = total + term / (k * (k - 1))
        if new == total:
            return mean * total
        total, term, k = new, -term * e, k + 1


def binomial_p_value(b: int, c: int) -> float:
    """Exact two-sided p of b against c at one half: min(1, 2 P(X <= min(b, c))), for any counts.

    The largest term comes from Stirling's series, so no large logarithms cancel; the smaller
    terms follow by their ratios until they no longer count, about sqrt(b + c) of them.
    """
    n, m = b + c, min(b, c)
    if b == c:
        return 1.0  # at least half of the distribution lies at or below the middle
    if m == 0:
        return min(1.0, 2.0 * 0.5 ** n)  # below the smallest number it is 0
    top = math.exp(_stirling_error(n) - _stirling_error(m) - _stirling_error(n - m) - _deviance(m, n / 2)
                   - _deviance(n - m, n / 2)) * math.sqrt(n / (2 * math.pi * m * (n - m)))
    term, total, k = 1.0, 1.0, m
    while k > 0 and term > 1e-17 * total:
        term *= k / (n - k + 1)
        total += term
        k -= 1
    return min(1.0, 2.0 * top * total)


def binomial_p(b, c) -> Column:
    """``binomial_p_value`` of two count columns; there is one row per compared pair of models."""
    @F.pandas_udf("double")
    def p(bs: pd.Series, cs: pd.Series) -> pd.Series:
        return pd.Series([binomial_p_value(int(x), int(y)) for x, y in zip(bs, cs)], dtype=float)

    return p(b, c)


def normal_tail(z) -> Column:
    """Two-sided normal tail 2(1 - Phi(|z|)) by a rational erfc fit (error below 1.2e-7)."""
    # Coefficients of the published Chebyshev fit of erfc.
    coef = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(0.0)
    for k in reversed(coef):
        poly = poly * t + F.lit(k)
    return t * F.exp(-x * x + poly)


def _discordant(df: DataFrame, y: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(model_a, model_b, b, c) of prediction column pairs, all in one pass."""
    aggs = []
    for i, (p, q) in enumerate(pairs):
        ok_p, ok_q = F.col(p) == F.col(y), F.col(q) == F.col(y)
        aggs += [F.count_if(~ok_p & ok_q).alias(f"b{i}"), F.count_if(ok_p & ~ok_q).alias(f"c{i}")]
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("model_a"), F.lit(q).alias("model_b"),
                 F.col(f"b{i}").alias("b"), F.col(f"c{i}").alias("c"))
        for i, (p, q) in enumerate(pairs)])))


def mcnemar(df: DataFrame, y: str, pairs: list[tuple[str, str]], alpha=0.05) -> DataFrame:
    """Discordant counts, corrected chi-square and exact p for each pair of prediction columns."""
    d = _discordant(df, y, pairs)
    b, c = F.col("b"), F.col("c")
    chi = F.when(b + c == 0, F.lit(0.0)).otherwise(
        F.pow(F.abs(b - c) - F.lit(1.0), F.lit(2.0)) / F.greatest(b + c, F.lit(1)))
    return (d.withColumns({"chi2": chi, "p_value": binomial_p(b, c)})
            .withColumn("significant", (F.col("p_value") < alpha).cast("long")))


def pairwise_mcnemar(df: DataFrame, y: str, models: list[str]) -> DataFrame:
    return mcnemar(df, y, [(a, b) for i, a in enumerate(models) for b in models[i + 1:]])


def winner_vs_all(df: DataFrame, y: str, winner: str, models: list[str]) -> DataFrame:
    return mcnemar(df, y, [(winner, m) for m in models if m != winner])


def bootstrap_ci(df: DataFrame, row_id: str, y: str, score: str, n_boot=2000, ci=0.95,
                 threshold=0.5) -> DataFrame:
    """One row per metric: point value, percentile interval, spread and replicates used."""
    samples = bootstrap_metrics(df, row_id, y, score, n_boot, threshold)
    names = ("roc_auc", "average_precision", "f1")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names])
    spans = percentile_interval(samples.select(F.inline(rows)), ["metric"], "v", ci)
    pts = materialize(E.curve(E.score_cells(df, y, score)))
    point = E.auc_of_curve(pts).withColumn("average_precision", E.ap_of_curve(pts).scalar())
    conf = E.confusion_binary(df, y, E.at_threshold(score, threshold)).select("f1").scalar()
    point = point.withColumn("f1", conf).select(F.inline(rows)).withColumnRenamed("v", "point")
    return point.join(spans, "metric")


def bootstrap_multiclass(df: DataFrame, row_id: str, y: str, pred: str, n_boot=1000, ci=0.95) -> DataFrame:
    """Percentile intervals of accuracy, f1_weighted and f1_macro."""
    cells = class_cell_replicates(df, row_id, y, pred, n_boot)
    per = E.per_class_report(cells, ["b"])
    s = F.sum("support")
    m = per.groupBy("b").agg(
        ratio(F.sum("tp"), s).alias("accuracy"),
        ratio(F.sum(F.col("f1") * F.col("support")), s).alias("f1_weighted"), F.avg("f1").alias("f1_macro"))
    rows = F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("v"))
                     for x in ("accuracy", "f1_weighted", "f1_macro")])
    return percentile_interval(m.select(F.inline(rows)), ["metric"], "v", ci)


def compare_two_runs(a: DataFrame, b: DataFrame, key="model", metric="roc_auc") -> DataFrame:
    """Metric of shared models in two runs, with the change and its sign."""
    j = a.select(key, F.col(metric).alias("run_a")).join(b.select(key, F.col(metric).alias("run_b")), key)
    d = F.col("run_b") - F.col("run_a")
    return j.withColumn("delta", d).withColumn(
        "change", F.when(d > 0, "+").when(d < 0, "-").otherwise("="))


def weighted_vote(preds: DataFrame, auc: DataFrame, top=3, row_id="id") -> DataFrame:
    """Scores of the ``top`` models by AUC, weighted by AUC; class 1 above one half.

    ``preds``: (row id, model, p). ``auc``: (model, roc_auc), one row per model.
    """
    best = auc.orderBy(F.desc("roc_auc"), F.asc("model")).limit(top)
    best = best.withColumn("__w", ratio("roc_auc", F.sum("roc_auc").over(Window.partitionBy()), 1.0 / top))
    j = preds.join(best.select("model", "__w"), "model")
    out = j.groupBy(row_id).agg(F.sum(F.col("__w") * F.col("p")).alias("p"))
    return out.withColumn("prediction", (F.col("p") > 0.5).cast("long"))


def final_ranking(report: DataFrame, min_rows=C.MIN_TEST_ROWS) -> DataFrame:
    """Composite of AUC and best F1; degenerate or small-sample models rank last."""
    t = report.withColumn("composite", 0.5 * F.col("roc_auc") + 0.5 * F.col("f1_opt"))
    return E.rank_models(t, "composite", min_rows)


def final_comparison(scores: DataFrame, row_id: str, y="y", score="p", model="model", n_boot=2000, alpha=0.05,
                     min_rows=C.MIN_TEST_ROWS, threshold=0.5) -> DataFrame:
    """The final ranking with its evidence: one row per model.

    ``scores``: (row_id, y, model, p), all models on the same rows. Adds to the ranking the bootstrap
    intervals of AUC, average precision and F1, the discordant counts and exact p-value of McNemar's
    test against the winner (null for the winner), and ``winner``. There are as many bootstrap passes
    as models, whose names are the only rows on the driver.
    """
    scores = materialize(scores.select(row_id, y, model, score))
    ranked = materialize(final_ranking(E.binary_report(scores, y, score, [model]), min_rows))
    names = [r[model] for r in ranked.orderBy("rank").collect()]
    spans = None
    for name in names:
        samples = bootstrap_metrics(scores.where(F.col(model) == name), row_id, y, score, n_boot, threshold)
        rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("roc_auc", "average_precision", "f1")])
        part = samples.select(F.lit(name).alias("__m"), F.inline(rows))
        spans = part if spans is None else spans.unionByName(part)
    ci = percentile_interval(materialize(spans), ["__m", "metric"], "v")
    wide = ci.groupBy("__m").agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{side}")
                                   for m in ("roc_auc", "average_precision", "f1") for side, c in (("lo", "ci_lo"), ("hi", "ci_hi"))])
    # one column of class predictions per model: the winner meets every other one in one pass
    columns = {name: f"m{i}" for i, name in enumerate(names)}
    preds = scores.groupBy(row_id, y).agg(*[F.max(F.when(F.col(model) == name, (F.col(score) >= threshold).cast("long"))).alias(c)
                                            for name, c in columns.items()])
    against = winner_vs_all(preds, y, columns[names[0]], list(columns.values())) if len(names) > 1 else None
    out = ranked.join(wide, F.col(model) == F.col("__m"), "left").drop("__m").withColumn("winner", (F.col("rank") == 1).cast("long"))
    if against is None:
        return out
    label = F.lit(None).cast("string")
    for name, c in columns.items():
        label = F.when(F.col("model_b") == c, F.lit(name)).otherwise(label)
    test = against.select(label.alias("__m"), "b", "c", "p_value", (F.col("p_value") < alpha).cast("long").alias("differs"))
    return out.join(test, F.col(model) == F.col("__m"), "left").drop("__m")


def champion_by_task(runs: DataFrame, task="task", metric="metric", lower_is_better="lower") -> DataFrame:
    """Best run per task: ``runs`` has (task, source, model, metric, lower); ties by source."""
    v = F.when(F.col(lower_is_better) == 1, -F.col(metric)).otherwise(F.col(metric))
    w = Window.partitionBy(task).orderBy(v.desc_nulls_last(), F.asc("source"))
    return runs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") == 1)


def cross_target_comparison(tables: list[DataFrame], metric: str, ascending: bool) -> DataFrame:
    """Comparison tables of several targets in one order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    order = F.asc(metric) if ascending else F.desc(metric)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(order, "model")).cast("long"))
