"""Binary and multiclass evaluation as tables.

Threshold curves work on cells (one row per model and distinct score), never on raw rows,
and the running sums over scores are range-split when there are many distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgrid import columns as C
from visitgrid.functions.core import ratio
from visitgrid.plans.ordered import materialize, prefix_sums


def _sum_if(cond: Column, w: Column) -> Column:
    return F.sum(F.when(cond, w).otherwise(F.lit(0)))


def _rates(tp, fp, fn, tn) -> dict[str, Column]:
    n = tp + fp + fn + tn
    return {"accuracy": ratio(tp + tn, n, 0), "precision": ratio(tp, tp + fp, 0),
            "recall": ratio(tp, tp + fn, 0), "f1": ratio(2 * tp, 2 * tp + fp + fn, 0)}


def confusion_binary(df: DataFrame, y: str, pred, keys=(), weight: str | None = None) -> DataFrame:
    """tn, fp, fn, tp and rates (0 on an empty denominator) per key."""
    w = F.lit(1) if weight is None else F.col(weight)
    a, b = F.col(y) == 1, (pred if isinstance(pred, Column) else F.col(pred)) == 1
    out = df.groupBy(*keys).agg(
        _sum_if(~a & ~b, w).alias("tn"), _sum_if(~a & b, w).alias("fp"),
        _sum_if(a & ~b, w).alias("fn"), _sum_if(a & b, w).alias("tp"))
    return out.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def at_threshold(score: str, threshold: float, inclusive=True) -> Column:
    s = F.col(score)
    return (s >= threshold if inclusive else s > threshold).cast("long")


def score_cells(df: DataFrame, y: str, score: str, keys=(), weight: str | None = None) -> DataFrame:
    """(keys, score) -> weighted positives and negatives."""
    w = F.lit(1) if weight is None else F.col(weight)
    cells = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        _sum_if(F.col(y) == 1, w).alias("pos"), _sum_if(F.col(y) != 1, w).alias("neg"))
    return cells if weight is None else cells.where(F.col("pos") + F.col("neg") > 0)


def curve(cells: DataFrame, keys=(), ranges: int | None = None) -> DataFrame:
    """Cumulative counts at every distinct threshold (score >= threshold)."""
    out = prefix_sums(cells, list(keys), "score", ["pos", "neg"], descending=True,
                      ranges=ranges)
    return out.select(*keys, "score", "pos", "neg", F.col("cum_pos").alias("tp"),
                      F.col("cum_neg").alias("fp"), F.col("tot_pos").alias("n_pos"),
                      F.col("tot_neg").alias("n_neg"))


def auc_of_curve(points: DataFrame, keys=()) -> DataFrame:
    """Exact area under ROC: each positive counts the lower negatives, ties one half."""
    below = F.col("n_neg") - F.col("fp")
    part = F.sum(F.col("pos") * (below + F.col("neg") * F.lit(0.5)))
    out = points.groupBy(*keys).agg(part.alias("__u"), F.max("n_pos").alias("__p"),
                                    F.max("n_neg").alias("__n"))
    return out.select(*keys, ratio("__u", F.col("__p").cast("double") * F.col("__n")).alias("roc_auc"))


def ap_of_curve(points: DataFrame, keys=()) -> DataFrame:
    """Average precision: sum of recall steps times precision over distinct thresholds."""
    step = ratio("pos", "n_pos") * ratio("tp", F.col("tp") + F.col("fp"))
    return points.groupBy(*keys).agg(F.sum(step).alias("average_precision"))


def roc_auc(df, y, score, keys=(), weight=None, ranges=None) -> DataFrame:
    return auc_of_curve(curve(score_cells(df, y, score, keys, weight), keys, ranges), keys)


def average_precision(df, y, score, keys=(), weight=None, ranges=None) -> DataFrame:
    return ap_of_curve(curve(score_cells(df, y, score, keys, weight), keys, ranges), keys)


def roc_points(df, y, score, keys=()) -> DataFrame:
    p = curve(score_cells(df, y, score, keys), keys)
    return p.select(*keys, F.col("score").alias("threshold"), ratio("fp", "n_neg").alias("fpr"),
                    ratio("tp", "n_pos").alias("tpr"))


def pr_points(df, y, score, keys=()) -> DataFrame:
    """Precision and recall per threshold, with the prevalence as the baseline."""
    p = curve(score_cells(df, y, score, keys), keys)
    return p.select(*keys, F.col("score").alias("threshold"),
                    ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
                    ratio("tp", "n_pos").alias("recall"),
                    ratio("n_pos", F.col("n_pos") + F.col("n_neg")).alias("prevalence"))


def best_threshold_of_curve(points: DataFrame, keys=()) -> DataFrame:
    """Threshold with the largest 2PR/(P+R+1e-8); the lowest on ties; 0.5 if F1 never exceeds 0."""
    p, r = ratio("tp", F.col("tp") + F.col("fp"), 0), ratio("tp", "n_pos", 0)
    scored = points.select(*keys, "score", (2 * p * r / (p + r + F.lit(1e-8))).alias("__f"))
    best = scored.groupBy(*keys).agg(F.max(F.struct("__f", -F.col("score"))).alias("__b"))
    f = F.col("__b.__f")
    return best.select(*keys, F.when(f > 0, -F.col("__b.col2")).otherwise(F.lit(0.5)).alias("threshold"),
                       f.alias("f1"))


def f1_optimal_threshold(df, y, score, keys=()) -> DataFrame:
    return best_threshold_of_curve(curve(score_cells(df, y, score, keys), keys), keys)


def calibration_table(df: DataFrame, y: str, score: str, bins=10, keys=()) -> DataFrame:
    """Count, mean score, actual rate and gap per bin; bins are [lo, hi), the last closed."""
    step = 1.0 / bins
    # the float edges i * step, compared as they are; scores outside [0, 1] have no bin
    b = None
    for i in range(bins):
        lo, hi = i * step, (1.0 if i == bins - 1 else (i + 1) * step)
        upper = F.col(score) <= hi if i == bins - 1 else F.col(score) < hi
        cond = (F.col(score) >= lo) & upper
        b = F.when(cond, F.lit(i)) if b is None else b.when(cond, F.lit(i))
    out = (df.withColumn("bin", b.cast("long")).where(F.col("bin").isNotNull())
           .groupBy(*keys, "bin")
           .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_pred"),
                F.avg(F.col(y).cast("double")).alias("actual_rate")))
    return out.withColumn("gap", F.abs(F.col("mean_pred") - F.col("actual_rate")))


def degenerate_check(df: DataFrame, score: str, keys=()) -> DataFrame:
    """Flags constant scores (spread under 1e-6) and scores all above one half."""
    out = df.groupBy(*keys).agg(F.stddev_pop(score).alias("p_std"), F.min(score).alias("p_min"),
                                F.max(score).alias("p_max"))
    flat = F.col("p_std") < 1e-6
    return out.withColumns({"degenerate": flat.cast("long"),
                            "all_positive": (~flat & (F.col("p_min") > 0.5)).cast("long")})


def binary_report(df: DataFrame, y: str, score: str, keys=("model",), threshold=0.5) -> DataFrame:
    """One row per model: rates at 0.5, AUC, AP, best threshold, degenerate flag, row count."""
    keys = list(keys)
    pts = materialize(curve(score_cells(df, y, score, keys), keys))
    above = F.col("score") >= threshold
    conf = pts.groupBy(*keys).agg(
        _sum_if(above, F.col("pos")).alias("tp"), _sum_if(above, F.col("neg")).alias("fp"),
        F.max("n_pos").alias("__p"), F.max("n_neg").alias("__n"))
    conf = conf.withColumns({"fn": F.col("__p") - F.col("tp"), "tn": F.col("__n") - F.col("fp"),
                             "n_test": F.col("__p") + F.col("__n")})
    conf = conf.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))
    n = F.col("pos") + F.col("neg")
    mean = F.sum(F.col("score") * n) / F.sum(n)
    spread = pts.groupBy(*keys).agg(
        (F.sum(F.col("score") * F.col("score") * n) / F.sum(n) - mean * mean).alias("__var"))
    out = conf.drop("__p", "__n").join(auc_of_curve(pts, keys), keys).join(
        ap_of_curve(pts, keys), keys)
    best = best_threshold_of_curve(pts, keys).select(
        *keys, F.col("threshold").alias("opt_threshold"), F.col("f1").alias("f1_opt"))
    flag = spread.select(*keys, (F.col("__var") < 1e-12).cast("long").alias("degenerate"))
    return out.join(best, keys).join(flag, keys)


def rank_models(table: DataFrame, metric="roc_auc", min_rows=C.MIN_TEST_ROWS) -> DataFrame:
    """Order a comparison table by metric; degenerate or small-sample models go last."""
    ok = (F.col("degenerate") == 0) & (F.col("n_test") >= min_rows)
    w = Window.orderBy(F.desc("eligible"), F.desc(metric), F.asc("model"))  # one row per model
    return (table.withColumn("eligible", ok.cast("long"))
            .withColumn("rank", F.row_number().over(w).cast("long")))


def next_usable_model(ranked: DataFrame, usable: DataFrame, metric="roc_auc") -> DataFrame:
    """The best-ranked model that can score new rows (``usable``: model, usable)."""
    ok = ranked.join(usable.where(F.col("usable") == 1).select("model"), "model", "left_semi")
    return ok.orderBy("rank").limit(1).select("model", "rank", metric)


# -- multiclass ----------------------------------------------------------------

def class_cells(df: DataFrame, y: str, pred: str, keys=()) -> DataFrame:
    """(keys, actual, predicted) counts: all multiclass metrics derive from them."""
    return df.groupBy(*keys, F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class_report(cells: DataFrame, keys=()) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    keys = list(keys)
    hit = F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0))
    side = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("pred"), hit.cast("long").alias("tp")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("pred"), F.lit(0).cast("long").alias("tp")))
    by = cells.select(*keys, F.inline(side)).groupBy(*keys, "class").agg(
        F.sum("support").alias("support"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp"))
    return by.select(*keys, "class", "support", "tp",
                     ratio("tp", "pred", 0).alias("precision"), ratio("tp", "support", 0).alias("recall"),
                     ratio(2 * F.col("tp"), F.col("support") + F.col("pred"), 0).alias("f1"))


def multiclass_metrics(df: DataFrame, y: str, pred: str, keys=()) -> DataFrame:
    """accuracy, f1_weighted, f1_macro per key, from the class counts."""
    per = per_class_report(class_cells(df, y, pred, keys), keys)
    s = F.sum("support")
    return per.groupBy(*keys).agg(
        s.alias("n"), ratio(F.sum("tp"), s).alias("accuracy"),
        ratio(F.sum(F.col("f1") * F.col("support")), s).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"))


def ovr_weighted_auc(df: DataFrame, y: str, cls: str, p: str) -> DataFrame:
    """One-vs-rest AUC per class weighted by support; input is (actual, class, probability) rows."""
    d = df.select(F.col(cls).alias("cls"), F.col(p).alias("p"),
                  (F.col(y) == F.col(cls)).cast("long").alias("hit"))
    pts = curve(score_cells(d, "hit", "p", ["cls"]), ["cls"])
    part = F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") * F.lit(0.5)))
    by = pts.groupBy("cls").agg(part.alias("u"), F.max("n_pos").alias("p"), F.max("n_neg").alias("n"))
    by = by.where((F.col("p") > 0) & (F.col("n") > 0))
    auc = F.col("u") / (F.col("p").cast("double") * F.col("n"))
    return by.agg(ratio(F.sum(auc * F.col("p")), F.sum("p")).alias("auc_ovr_weighted"))


def confusion_multiclass(df: DataFrame, y: str, pred: str, classes: list[str]) -> DataFrame:
    """Label x label counts, zero filled; ``classes`` fixes the columns."""
    return (df.groupBy(F.col(y).alias("actual")).pivot(pred, classes)
            .agg(F.count(F.lit(1))).fillna(0))


def agreement_matrix(df: DataFrame, models: list[str]) -> DataFrame:
    """Share of rows on which two prediction columns agree; one pass over the wide table."""
    pairs = [(a, b) for a in models for b in models]
    one = df.agg(*[F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias(f"__{i}")
                   for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"__{i}").alias("agreement"))
        for i, (a, b) in enumerate(pairs)])))


# Training-support thresholds of the sensitivity tables.
SUPPORT_THRESHOLDS = (1, 2, 3, 5, 10, 20, 50)


def with_support(test: DataFrame, train: DataFrame, cls: str, out="support") -> DataFrame:
    """Training rows of each test row's class; 0 when unseen."""
    n = train.groupBy(F.col(cls).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    j = test.join(n, F.col(cls) == F.col("__c"), "left")
    return j.select(*test.columns, F.coalesce("__n", F.lit(0)).alias(out))


def min_support_sensitivity(df: DataFrame, y: str, pred: str, support="support",
                            thresholds=SUPPORT_THRESHOLDS) -> DataFrame:
    """Multiclass metrics on rows whose class has enough training rows, per threshold."""
    # class counts first: thresholds multiply the few cells, not the rows
    cells = df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted"), support).agg(
        F.count(F.lit(1)).alias("n"))
    t = F.explode(F.filter(F.array(*[F.lit(x) for x in thresholds]),
                           lambda x: x <= F.col(support))).alias("min_support")
    cells = cells.select("actual", "predicted", "n", t)
    cells = cells.groupBy("min_support", "actual", "predicted").agg(F.sum("n").alias("n"))
    per = per_class_report(cells, ["min_support"])
    s = F.sum("support")
    return per.groupBy(F.col("min_support").cast("long").alias("min_support")).agg(
        s.alias("n_test"), ratio(F.sum(F.col("f1") * F.col("support")), s).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"), ratio(F.sum("tp"), s).alias("accuracy")).where(F.col("n_test") >= 2)
