"""Training and scoring with Spark ML. Fits run on the executors; only fitted models and
metric tables of a few rows come back."""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.evaluation import (BinaryClassificationEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitgrid.functions.core import md5_int
from visitgrid.operators import cells as CL
from visitgrid.operators import evaluate as E
from visitgrid.operators.aggregates import consensus_importance
from visitgrid.operators.forest import fit_forest, on_cells
from visitgrid.operators.sampling import hash_folds, stratified_kfold
from visitgrid.plans.ordered import exact_quantiles, materialize, wide_quantiles

SEED = 42
#: Rows up to which a fit reads a table of its own, in one order; above, it reads its input as it is
#: written already (trees: as counted cells). Every fit reads all rows.
OWN_ROWS = 20_000
#: Rows per partition of the table that a fit reads, so that small fits run in few tasks.
FIT_PARTITION, LARGE_PARTITION = 10_000, 1_000_000
# Sizes of the models, trees and rounds as well as depths.
TREES, TREE_DEPTH, ROUNDS, ROUND_DEPTH, STEP, LINEAR_ITERATIONS = 300, 20, 100, 5, 0.1, 1000


def together(fits, threads: int = 4) -> list:
    """Results of functions, called in parallel threads: the short jobs of one fit fill the gaps of another."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(fit) for fit in fits]]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit_table(df: DataFrame, columns, bound: int | None = None) -> DataFrame:
    """The rows that a fit reads, written once: all of them, or about ``bound`` by a hash of the row."""
    columns = list(dict.fromkeys(columns))
    rows = df.select(*columns)
    n = rows.count()
    h = F.pmod(F.xxhash64(*columns), F.lit(1 << 20))
    if bound and n > bound:
        rows = rows.where(h < int(bound / n * (1 << 20)))
    kept = min(n, bound or n)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(1, min(-(-kept // FIT_PARTITION), max(tasks, kept // LARGE_PARTITION)))
    # one order of the rows, whatever order they came in: equal tables give equal models
    return materialize(rows.withColumn("__h", h).repartition(parts, "__h").sortWithinPartitions("__h", *columns).drop("__h"))


def _assembler(features: list[str], out="features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def class_weights(df: DataFrame, label: str, cap: float | None = None) -> DataFrame:
    """Balanced weight n / (classes * n_class) per class. With ``cap``, a class counts at most
    ``cap`` times as much per row as the largest one (two classes: min(neg / pos, cap))."""
    counts = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))
    t = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.max("n").alias("top"))).scalar()
    w = t["n"] / (t["k"] * F.col("n"))
    if cap is not None:
        w = t["n"] / (t["k"] * t["top"]) * F.least(t["top"] / F.col("n"), F.lit(float(cap)))
    return counts.withColumn("weight", w)


def with_class_weight(df: DataFrame, label: str, out="__w") -> DataFrame:
    """Attach balanced weights by a join with the table of classes."""
    rows = materialize(class_weights(df, label).select(F.col(label).alias("__l"), F.col("weight").alias(out)))
    return df.join(rows, df[label].eqNullSafe(rows["__l"]), "left").drop("__l")


def fit_majority(df: DataFrame, label: str) -> DataFrame:
    """The most frequent class (ties to the smallest) and its share: the floor for other models."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    best = counts.orderBy(F.desc("n"), F.asc(label)).limit(1)
    return best.select(F.col(label).alias("prediction"), (F.col("n") / total).alias("share"))


def classifier(kind: str, label: str, weight: str | None = None, **params):
    """logreg, rf or gbt with the label and weight columns set."""
    kw = {"labelCol": label, "featuresCol": "features", **params}
    if weight is not None:
        kw["weightCol"] = weight
    if kind == "logreg":
        return MC.LogisticRegression(**{"maxIter": LINEAR_ITERATIONS, "standardization": True, **kw})
    if kind == "rf":
        return MC.RandomForestClassifier(**{"numTrees": TREES, "maxDepth": TREE_DEPTH, "minInstancesPerNode": 2, "seed": SEED, **kw})
    if kind == "gbt":
        return MC.GBTClassifier(**{"maxIter": ROUNDS, "maxDepth": ROUND_DEPTH, "stepSize": STEP, "seed": SEED, **kw})
    raise ValueError(kind)


def regressor(kind: str, label: str, **params):
    """ridge, lasso, elastic, rf or gbt."""
    kw = {"labelCol": label, "featuresCol": "features"}
    if kind in ("ridge", "lasso", "elastic"):
        mix = {"ridge": 0.0, "lasso": 1.0, "elastic": 0.3}[kind]
        reg = {"ridge": 1e-3, "lasso": 0.01, "elastic": 0.005}[kind]
        return MR.LinearRegression(**{"maxIter": LINEAR_ITERATIONS, "elasticNetParam": mix, "regParam": reg, **kw, **params})
    if kind == "rf":
        return MR.RandomForestRegressor(**{"numTrees": TREES, "maxDepth": TREE_DEPTH, "minInstancesPerNode": 2, "seed": SEED, **kw, **params})
    if kind == "gbt":
        return MR.GBTRegressor(**{"maxIter": ROUNDS, "maxDepth": ROUND_DEPTH, "stepSize": STEP, "seed": SEED, **kw, **params})
    raise ValueError(kind)


def fit_input(train: DataFrame, columns, rows: int) -> DataFrame:
    """All rows for a fit that Spark ML keeps or sums up itself: a table of their own only where it is small."""
    return fit_table(train, columns) if rows <= OWN_ROWS else train.select(*dict.fromkeys(columns))


def fit_classifier(train: DataFrame, features, label, kind="logreg", balanced=True, **params) -> PipelineModel:
    weight, rows = None, train.count()
    if kind == "rf" and on_cells(classifier(kind, label, **params), rows):
        forest = CL.grow_forest(classifier(kind, label, **params), train, features, True, balanced)
        if forest is not None:
            return forest
    if kind == "gbt" and rows > OWN_ROWS and not {"minInstancesPerNode", "subsamplingRate", "maxBins"} & set(params):
        return CL.fit_on_cells(classifier(kind, label, **params), train, features, CL.balance() if balanced else None)
    train = fit_input(train, [*features, label], rows) if kind != "rf" else fit_table(train, [*features, label])
    if balanced:
        train, weight = with_class_weight(train, label), "__w"
    if kind == "rf":
        return fit_forest(lambda **more: classifier(kind, label, weight, **{**params, **more}), train, features)
    return Pipeline(stages=[_assembler(features), classifier(kind, label, weight, **params)]).fit(train)


def fit_gbt_multiclass(train: DataFrame, features, label, **params) -> PipelineModel:
    """Boosted trees are binary in Spark ML: one model per class."""
    ovr = MC.OneVsRest(classifier=classifier("gbt", label, **params), labelCol=label,
                       featuresCol="features", parallelism=4)
    rows = train.count()
    if rows > OWN_ROWS and not {"minInstancesPerNode", "subsamplingRate", "maxBins"} & set(params):
        return CL.fit_on_cells(ovr, train, features)
    return Pipeline(stages=[_assembler(features), ovr]).fit(fit_table(train, [*features, label]))


def fit_regressor(train: DataFrame, features, label, kind="ridge", **params) -> PipelineModel:
    """Linear models work on standardised inputs; trees take them as they are."""
    if kind in ("ridge", "lasso", "elastic"):
        stages = [_assembler(features, "__raw"),
                  StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True)]
    else:
        stages = [_assembler(features)]
    rows = train.count()
    if kind == "rf" and on_cells(regressor(kind, label, **params), rows):
        forest = CL.grow_forest(regressor(kind, label, **params), train, features, False, False)
        if forest is not None:
            return forest
    if kind == "gbt" and rows > OWN_ROWS and not {"minInstancesPerNode", "subsamplingRate", "maxBins"} & set(params):
        return CL.fit_on_cells(regressor(kind, label, **params), train, features)
    train = fit_input(train, [*features, label], rows) if kind != "rf" else fit_table(train, [*features, label])
    if kind == "rf":
        return fit_forest(lambda **more: regressor(kind, label, **{**params, **more}), train, features)
    return Pipeline(stages=[*stages, regressor(kind, label, **params)]).fit(train)


def positive_score(model: PipelineModel, df: DataFrame, out="p") -> DataFrame:
    """Probability of class 1 next to the input columns."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def class_scores(model: PipelineModel, df: DataFrame, keep, classes: list[str]) -> DataFrame:
    """Long (keep..., cls, code, p) class probabilities."""
    scored = model.transform(df).select(*keep, vector_to_array("probability").alias("__ps"))
    rows = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("cls"), F.col("__ps").alias("p"))
    return scored.select(*keep, F.posexplode(rows).alias("code", "__z")).select(
        *keep, F.col("__z")["cls"].alias("cls"), F.col("code").cast("long").alias("code"), F.col("__z")["p"].alias("p"))


def predicted(model: PipelineModel, df: DataFrame, out="prediction") -> DataFrame:
    return model.transform(df).select(*df.columns, F.col("prediction").alias(out))


def score_threshold(model: PipelineModel, df: DataFrame, threshold: float, out="prob_coming") -> DataFrame:
    """Rows whose probability of class 1 reaches the threshold."""
    return positive_score(model, df, out).where(F.col(out) >= threshold)


def coefficient_table(model: PipelineModel, features, train: DataFrame, top=25) -> DataFrame:
    """Coefficients of a linear classifier by size; the frame supplies the session."""
    coef = model.stages[-1].coefficients.toArray()
    rows = [(f, float(c)) for f, c in zip(features, coef)]
    df = train.sparkSession.createDataFrame(rows, "feature string, coefficient double")
    return df.orderBy(F.desc(F.abs("coefficient")), "feature").limit(top)


def importance_table(model: PipelineModel, features, name: str, train: DataFrame) -> DataFrame:
    """(model, feature, importance) of a tree ensemble."""
    imp = model.stages[-1].featureImportances.toArray()
    rows = [(name, f, float(v)) for f, v in zip(features, imp)]
    return train.sparkSession.createDataFrame(rows, "model string, feature string, importance double")


def rf_importance_prefilter(train: DataFrame, features, label, top: int, task="class") -> tuple[list[str], DataFrame]:
    """Names of the ``top`` features of a scout forest, and its importance table."""
    if task == "class":
        m = fit_classifier(train, features, label, "rf")
    else:
        m = fit_regressor(train, features, label, "rf")
    table = importance_table(m, features, "scout", train)
    ranked = table.orderBy(F.desc("importance"), F.asc("feature")).limit(top)
    return [r["feature"] for r in ranked.collect()], ranked


def feature_selection_retrain(train: DataFrame, test: DataFrame, features, label, top=15,
                              kinds=("rf", "gbt")) -> DataFrame:
    """Consensus features of several ensembles, then AUC of each model before and after."""
    tables, before = None, None
    for kind, m in zip(kinds, together([lambda kind=kind: fit_classifier(train, features, label, kind) for kind in kinds])):
        t = importance_table(m, features, kind, train)
        s = positive_score(m, test, "__p").select(F.lit(kind).alias("model"), label, "__p")
        tables = t if tables is None else tables.unionByName(t)
        before = s if before is None else before.unionByName(s)
    kept = [r["feature"] for r in consensus_importance(tables, top).collect()]
    after = None
    for kind, m in zip(kinds, together([lambda kind=kind: fit_classifier(train, kept, label, kind) for kind in kinds])):
        s = positive_score(m, test, "__p").select(F.lit(kind).alias("model"), label, "__p")
        after = s if after is None else after.unionByName(s)
    a = E.roc_auc(before, label, "__p", ["model"]).withColumnRenamed("roc_auc", "auc_all")
    b = E.roc_auc(after, label, "__p", ["model"]).withColumnRenamed("roc_auc", "auc_selected")
    return a.join(b, "model").withColumn("n_selected", F.lit(len(kept)))


def cross_validate(df: DataFrame, row_id: str, features, label, kinds=("logreg", "rf"), k=3,
                   fit=fit_classifier) -> DataFrame:
    """Mean and population deviation of the exact fold AUC per model."""
    folds = materialize(stratified_kfold(df, row_id, label, k))
    jobs = [(i, kind) for i in range(k) for kind in kinds]
    models = together([lambda i=i, kind=kind: fit(folds.where(F.col("fold") != i), features, label, kind) for i, kind in jobs])
    scores = _union(together([lambda i=i, kind=kind, m=m: positive_score(m, folds.where(F.col("fold") == i), "__p").select(
        F.lit(kind).alias("model"), "fold", label, "__p") for (i, kind), m in zip(jobs, models)]))
    auc = E.roc_auc(scores, label, "__p", ["model", "fold"])
    return auc.groupBy("model").agg(F.avg("roc_auc").alias("cv_auc_mean"),
                                    F.stddev_pop("roc_auc").alias("cv_auc_std"))


# Parameter choices of the random search.
SEARCH_SPACE = {
    "logreg": {"regParam": [0.0, 0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
    "rf": {"numTrees": [100, 200, 300], "maxDepth": [5, 10, 20], "minInstancesPerNode": [1, 2, 5]},
    "gbt": {"maxIter": [100, 200, 300], "maxDepth": [3, 5, 6], "stepSize": [0.03, 0.05, 0.1]},
    "ridge": {"regParam": [0.0001, 0.001, 0.01, 0.1, 1.0]},
}


def hyperparameter_search(df: DataFrame, row_id: str, features, label, kind="logreg", trials=4,
                          k=3, metric="auc", seed=SEED, parallelism=2) -> DataFrame:
    """Seeded random search with hashed folds: (trial, params, score), best first.

    ``metric``: auc, f1 (weighted) or mae; every row has a fold, so no split is drawn anew.
    """
    rng = random.Random(seed)
    space = SEARCH_SPACE[kind]
    every = [{}]
    for name, values in space.items():
        every = [{**d, name: v} for d in every for v in values]
    picks = rng.sample(every, min(trials, len(every)))
    est = regressor(kind, label) if metric == "mae" else classifier(kind, label)
    grid = [{est.getParam(n): v for n, v in p.items()} for p in picks]
    ev = {"auc": lambda: BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC"),
          "f1": lambda: MulticlassClassificationEvaluator(labelCol=label, metricName="f1"),
          "mae": lambda: RegressionEvaluator(labelCol=label, metricName="mae")}[metric]()
    folded = (hash_folds(df, row_id, k) if metric == "mae" else stratified_kfold(df, row_id, label, k))
    # features are assembled and written once: a fit reads its rows, not the plan that made them
    data = materialize(_assembler(features).transform(folded).select("features", label, F.col("fold").cast("int").alias("fold")))
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid or ParamGridBuilder().build(),
                        evaluator=ev, numFolds=k, foldCol="fold", parallelism=parallelism)
    avg = cv.fit(data).avgMetrics
    rows = [(i, json.dumps(p, sort_keys=True), float(s)) for i, (p, s) in enumerate(zip(picks, avg))]
    out = df.sparkSession.createDataFrame(rows, "trial int, params string, score double")
    return out.orderBy(F.asc("score") if metric == "mae" else F.desc("score"), "trial")


def tuned_or_default(search: DataFrame, floor=0.55) -> dict:
    """Parameters of the best trial, or none when it does not beat ``floor`` (AUC)."""
    best = search.orderBy(F.desc("score"), "trial").first()
    return json.loads(best["params"]) if best is not None and best["score"] > floor else {}


def permuted_columns(df: DataFrame, row_id: str, features) -> DataFrame:
    """Each feature with its values moved between rows, as ``__perm_<feature>``.

    All rows stand in one random order, that of their id's hash; feature number i takes the value
    i + 1 places on, the last rows those of the first. The order is cut in ranges: inside a range
    a window moves the values, and across its end the first rows of the next ranges stand in.
    """
    features = list(features)
    lags = len(features)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = materialize(df.withColumn("__h", md5_int(row_id)).repartitionByRange(n, "__h", row_id)
                       .withColumn("__b", F.spark_partition_id()))
    order = Window.partitionBy("__b").orderBy("__h", row_id)
    ranges = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__size"))
    every, upto = Window.partitionBy(), Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = materialize(ranges.select("__b", "__size", F.sum("__size").over(upto).alias("__end"),
                                       F.sum("__size").over(every).alias("__all")))
    placed = rows.withColumn("__at", F.row_number().over(order)).join(ranges, "__b")
    start = F.col("__end") - F.col("__size")
    # the first rows of every range, by their place in the whole order
    heads = placed.where(F.col("__at") <= lags).select(
        (start + F.col("__at") - 1).alias("__place"), F.struct(*features).alias("__v"))
    after = F.explode(F.sequence(F.lit(0), F.lit(lags - 1)))
    wanted = ranges.select(F.col("__b").alias("__tb"), after.alias("__j"), "__end", "__all")
    tails = (wanted.join(heads, F.pmod(F.col("__end") + F.col("__j"), F.col("__all")) == F.col("__place"))
             .groupBy("__tb").agg(F.sort_array(F.collect_list(F.struct("__j", "__v"))).alias("__next")))
    tails = materialize(tails)
    out = []
    for i, f in enumerate(features):
        beyond = F.col("__at") + i + 1 - F.col("__size")
        moved = F.get("__next", (beyond - 1).cast("int"))["__v"][f]
        out.append(F.when(beyond > 0, moved).otherwise(F.col(f"__lead_{i}")).alias(f"__perm_{f}"))
    led = placed.select("*", *[F.lead(f, i + 1).over(order).alias(f"__lead_{i}") for i, f in enumerate(features)])
    return led.join(tails, F.col("__b") == F.col("__tb")).select(*df.columns, *out)


def permutation_importance(model: PipelineModel, test: DataFrame, row_id: str, features, label,
                           top=20) -> DataFrame:
    """AUC loss when one feature is permuted, largest first."""
    perm = materialize(permuted_columns(test, row_id, features))
    scores = positive_score(model, perm, "__p").select(F.lit("").alias("feature"), label, "__p")
    for f in features:
        moved = perm.withColumn(f, F.col(f"__perm_{f}"))
        scores = scores.unionByName(positive_score(model, moved, "__p").select(F.lit(f).alias("feature"), label, "__p"))
    auc = materialize(E.roc_auc(scores, label, "__p", ["feature"]))
    base = auc.where(F.col("feature") == "").select("roc_auc").scalar()
    return (auc.where(F.col("feature") != "")
            .select("feature", (base - F.col("roc_auc")).alias("importance"))
            .orderBy(F.desc("importance"), "feature").limit(top))


def partial_dependence(model: PipelineModel, df: DataFrame, features, points=10) -> DataFrame:
    """Mean score over all rows with one feature fixed on a grid between its P1 and P99."""
    out = None
    ends = {r["feature"]: r for r in wide_quantiles(df, features, {"lo": 0.01, "hi": 0.99}).collect()}
    for f in features:
        q = ends[f]
        grid = [q["lo"] + (q["hi"] - q["lo"]) * i / (points - 1) for i in range(points)]
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v"))
                                 for i, v in enumerate(grid)]))
        fixed = df.withColumn("__g", at).withColumn(f, F.col("__g.v"))
        part = positive_score(model, fixed, "__p").groupBy(F.col("__g.i").alias("point"), F.col("__g.v").alias("value")).agg(
            F.avg("__p").alias("mean_p")).select(F.lit(f).alias("feature"), "point", "value", "mean_p")
        out = part if out is None else out.unionByName(part)
    return out


def ice_sample(model: PipelineModel, df: DataFrame, row_id: str, feature: str, rows=100, points=10) -> DataFrame:
    """Individual curves of ``rows`` hash-chosen rows."""
    some = df.orderBy(md5_int(row_id), F.col(row_id)).limit(rows)
    q = exact_quantiles(df, [], feature, {"lo": 0.01, "hi": 0.99}).first()
    grid = [q["lo"] + (q["hi"] - q["lo"]) * i / (points - 1) for i in range(points)]
    fixed = some.withColumn(feature, F.explode(F.array(*[F.lit(v) for v in grid])))
    return positive_score(model, fixed, "__p").select(row_id, F.col(feature).alias("value"), F.col("__p").alias("score"))


# Train shares of the learning curve.
CURVE_SHARES = (0.15, 0.3, 0.45, 0.6, 0.75, 0.9, 1.0)


def learning_curve(df: DataFrame, row_id: str, features, label, kind="logreg", k=3,
                   shares=CURVE_SHARES) -> DataFrame:
    """Train and held-out AUC by train share (hash-prefix samples), averaged over folds."""
    u = md5_int(F.concat(row_id, F.lit("lc"))) % 10000
    # written once: every fit and every scored part would deal the folds anew
    folds = materialize(stratified_kfold(df, row_id, label, k).select(*dict.fromkeys([*features, label]), "fold", u.alias("__u")))
    scores = None
    for share in shares:
        for i in range(k):
            tr = folds.where((F.col("fold") != i) & (F.col("__u") < int(share * 10000)))
            m = fit_classifier(tr, features, label, kind)
            for name, part in (("train", tr), ("valid", folds.where(F.col("fold") == i))):
                s = positive_score(m, part, "__p").select(F.lit(share).alias("share"), F.lit(i).alias("f"),
                                                   F.lit(name).alias("part"), label, "__p")
                scores = s if scores is None else scores.unionByName(s)
    auc = E.roc_auc(scores, label, "__p", ["share", "f", "part"])
    return auc.groupBy("share", "part").agg(F.avg("roc_auc").alias("auc_mean"),
                                            F.stddev_pop("roc_auc").alias("auc_std"))


def out_of_fold(df: DataFrame, row_id: str, features, label, kinds, k=3, task="class") -> DataFrame:
    """Wide out-of-fold predictions: one column per model kind."""
    folds = materialize(stratified_kfold(df, row_id, label, k) if task == "class" else hash_folds(df, row_id, k))
    fit = fit_classifier if task == "class" else fit_regressor
    jobs = [(i, kind) for i in range(k) for kind in kinds]
    models = dict(zip(jobs, together([lambda i=i, kind=kind: fit(folds.where(F.col("fold") != i), features, label, kind) for i, kind in jobs])))

    def held_out(i):
        wide = folds.where(F.col("fold") == i).select(row_id, label, *features)
        for kind in kinds:
            wide = (positive_score if task == "class" else predicted)(models[i, kind], wide, f"oof_{kind}")
        return wide.select(row_id, label, *[f"oof_{kind}" for kind in kinds])

    return _union(together([lambda i=i: held_out(i) for i in range(k)]))


def stacking_oof(df: DataFrame, row_id: str, features, label, kinds, k=3, task="class"):
    """(out-of-fold table, fitted meta-learner on it). The meta input columns are ``oof_<kind>``."""
    oof = materialize(out_of_fold(df, row_id, features, label, kinds, k, task))
    cols = [f"oof_{kind}" for kind in kinds]
    if task == "class":
        return oof, fit_classifier(oof, cols, label, "gbt")
    return oof, Pipeline(stages=[_assembler(cols), regressor("ridge", label)]).fit(oof)


def stack_predict(models: dict, meta: PipelineModel, df: DataFrame, task="class", out="p") -> DataFrame:
    """Scores of fully fitted base models fed to the meta-learner."""
    wide = df
    for kind, m in models.items():
        wide = (positive_score(m, wide, f"oof_{kind}") if task == "class"
                else predicted(m, wide, f"oof_{kind}"))
    scored = positive_score(meta, wide, out) if task == "class" else predicted(meta, wide, out)
    return scored.select(*df.columns, out)


def class_vector(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """The probabilities of all classes as one vector column next to the input columns."""
    return model.transform(df).select(*df.columns, F.col("probability").alias(out))


def out_of_fold_classes(df: DataFrame, row_id: str, features, label, kinds, k=3) -> DataFrame:
    """Wide out-of-fold probability vectors ``oof_<kind>`` of a classification with any number of classes.

    Every fold has every class (folds are dealt by class), so all vectors have one entry per class.
    """
    folds = materialize(stratified_kfold(df.select(row_id, label, *features), row_id, label, k))
    jobs = [(i, kind) for i in range(k) for kind in kinds]
    models = dict(zip(jobs, together([lambda i=i, kind=kind: fit_classifier(folds.where(F.col("fold") != i), features, label, kind)
                                      for i, kind in jobs])))

    def held_out(i):
        wide = folds.where(F.col("fold") == i).drop("fold")
        for kind in kinds:
            wide = class_vector(models[i, kind], wide, f"oof_{kind}")
        return wide.select(row_id, label, *[f"oof_{kind}" for kind in kinds])

    return _union(together([lambda i=i: held_out(i) for i in range(k)]))


def stack_classes(train: DataFrame, row_id: str, features, label, kinds, k=3):
    """(base models, meta model): a multinomial model learns from the bases' out-of-fold vectors; the
    bases are then fitted on all rows."""
    oof = materialize(out_of_fold_classes(train, row_id, features, label, kinds, k))
    meta = Pipeline(stages=[_assembler([f"oof_{kind}" for kind in kinds]), classifier("logreg", label, regParam=1e-3)]).fit(oof)
    return {kind: fit_classifier(train, features, label, kind) for kind in kinds}, meta


def stack_class_predict(bases: dict, meta: PipelineModel, df: DataFrame, out="prediction") -> DataFrame:
    """The stack's class next to the bases' own, ``<out>_<kind>``."""
    wide = df
    for kind, m in bases.items():
        wide = m.transform(wide).select(*wide.columns, F.col("probability").alias(f"oof_{kind}"), F.col("prediction").alias(f"{out}_{kind}"))
    return meta.transform(wide).select(*df.columns, *[f"{out}_{kind}" for kind in bases], F.col("prediction").alias(out))


def sigmoid_maps(scores: DataFrame, by: str, p: str, hit: str, rounds=25) -> DataFrame:
    """(by, a, b): per group the map 1 / (1 + exp(-(a p + b))) of greatest likelihood, by Newton's method.

    A round is one aggregation over all rows for all groups at once: five sums per group. Targets are
    smoothed toward one half by the counts of both outcomes, so separable groups stay finite.
    """
    rows = materialize(scores.select(F.col(by).alias("__g"), F.col(p).cast("double").alias("__p"), (F.col(hit) == 1).cast("double").alias("__y")))
    counts = materialize(rows.groupBy("__g").agg(F.sum("__y").alias("pos"), F.sum(1 - F.col("__y")).alias("neg")))
    state = counts.select("__g", ((F.col("pos") + 1) / (F.col("pos") + 2)).alias("hi"), (1 / (F.col("neg") + 2)).alias("lo"),
                          F.lit(0.0).alias("a"), F.log((F.col("pos") + 1) / (F.col("neg") + 1)).alias("b"))
    for _ in range(rounds):
        state = materialize(state)
        at = rows.join(state.withColumnRenamed("__g", "__s"), F.col("__g").eqNullSafe(F.col("__s")))
        q = 1 / (1 + F.exp(-(F.col("a") * F.col("__p") + F.col("b"))))
        t = F.when(F.col("__y") == 1, F.col("hi")).otherwise(F.col("lo"))
        w = F.greatest(q * (1 - q), F.lit(1e-12))
        g = at.groupBy("__g", "hi", "lo", "a", "b").agg(
            F.sum((t - q) * F.col("__p")).alias("ga"), F.sum(t - q).alias("gb"), F.sum(w * F.col("__p") * F.col("__p")).alias("haa"),
            F.sum(w * F.col("__p")).alias("hab"), F.sum(w).alias("hbb"))
        det = F.greatest(F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab"), F.lit(1e-12))
        da = (F.col("ga") * F.col("hbb") - F.col("gb") * F.col("hab")) / det
        db = (F.col("gb") * F.col("haa") - F.col("ga") * F.col("hab")) / det
        # long steps are shortened: far from the optimum the curve says little
        size = F.greatest(F.abs(da), F.abs(db))
        cut = F.when(size > 10, 10 / size).otherwise(F.lit(1.0))
        moved = materialize(g.select("__g", "hi", "lo", (F.col("a") + cut * da).alias("a"), (F.col("b") + cut * db).alias("b"), size.alias("moved")))
        state = moved.drop("moved")
        if (moved.agg(F.max("moved")).first()[0] or 0) < 1e-9:
            break
    return state.select(F.col("__g").alias(by), "a", "b")


def calibrated_classes(scores: DataFrame, maps: DataFrame, row_id: str, by="cls", p="p") -> DataFrame:
    """One-vs-rest calibration: every class's score through its map, then scaled to sum to one per row."""
    m = maps.select(F.col(by).alias("__c"), "a", "b")
    j = scores.join(m, F.col(by).eqNullSafe(F.col("__c")), "left")
    q = F.coalesce(1 / (1 + F.exp(-(F.col("a") * F.col(p) + F.col("b")))), F.col(p))
    per = Window.partitionBy(row_id)
    j = j.withColumn("__q", q)
    return j.select(*[c for c in scores.columns if c != p], F.coalesce(
        F.try_divide(F.col("__q"), F.sum("__q").over(per)), F.lit(1.0) / F.count(F.lit(1)).over(per)).alias(p))


def blend_classes(train: DataFrame, vectors: list[str], label: str) -> PipelineModel:
    """Multinomial blend of two scorers' probability vectors: 2C input columns for C classes."""
    return Pipeline(stages=[_assembler(vectors), classifier("logreg", label, regParam=1e-3)]).fit(train)


def quantile_forest(train: DataFrame, new: DataFrame, row_id: str, features, label, probs: dict[str, float], **params) -> DataFrame:
    """Quantiles of the target per new row, by a forest whose leaves keep the quantiles of their train rows.

    The leaves of all trees are one table (tree, leaf) with exact quantiles; a row takes the mean of its
    leaves' quantiles, weighted by their rows. Leaves hold 20 rows or more unless ``params`` say otherwise.
    """
    model = fit_regressor(train, features, label, "rf", **{"minInstancesPerNode": 20, "maxDepth": 10, "leafCol": "leaves", **params})

    def leaves(df, *keep):
        at = model.transform(df).select(*keep, F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
        return at.withColumn("leaf", F.col("leaf").cast("int"))

    if isinstance(model, CL.CellForest):
        return _cell_quantiles(model, train, new, label, probs)
    # a leaf's rows are few (the trees split down to them), so its percentile buffer is small
    table = materialize(leaves(fit_table(train, [*features, label]), F.col(label).alias("__y")).groupBy("tree", "leaf").agg(
        F.count(F.lit(1)).alias("__n"), *[F.percentile("__y", F.lit(p)).alias(f"__{n}") for n, p in probs.items()]))
    found = leaves(new, F.col(row_id).alias("__id")).join(table, ["tree", "leaf"]).groupBy("__id").agg(
        *[(F.sum(F.col(f"__{n}") * F.col("__n")) / F.sum("__n")).alias(n) for n in probs])
    return new.join(found, new[row_id] == found["__id"]).drop("__id")


def _cell_quantiles(model: CL.CellForest, train: DataFrame, new: DataFrame, label: str, probs: dict[str, float]) -> DataFrame:
    """``quantile_forest`` of a forest on cells: leaves count cells, and a new row takes its cell's quantiles."""
    keys = CL.keys_of(len(model.features))

    def leaves(cells, *keep):
        at = model.scored(cells.select(*keys).distinct()).select(*keys, F.posexplode("__leaves").alias("tree", "leaf"))
        return at if not keep else at.join(cells.select(*keys, *keep), keys)

    counted = CL.cells_of(train, model.features, model.cuts, label)
    table = materialize(leaves(counted, "y", "n").groupBy("tree", "leaf").agg(
        F.sum("n").alias("__n"), *[F.percentile("y", F.lit(p), F.col("n")).alias(f"__{n}") for n, p in probs.items()]))
    rows = CL.binned(new, model.features, model.cuts)
    found = leaves(rows).join(table, ["tree", "leaf"]).groupBy(*keys).agg(
        *[(F.sum(F.col(f"__{n}") * F.col("__n")) / F.sum("__n")).alias(n) for n in probs])
    return rows.join(materialize(found), keys).drop(*keys)


def soft_vote(preds: DataFrame, row_id: str) -> DataFrame:
    """Mean probability over models; class 1 above one half."""
    out = preds.groupBy(row_id).agg(F.avg("p").alias("p"))
    return out.withColumn("prediction", (F.col("p") > 0.5).cast("long"))


def platt_scaling(calibration: DataFrame, score: str, label: str) -> PipelineModel:
    """Sigmoid map of a score, fitted on held-out rows."""
    return Pipeline(stages=[_assembler([score]), classifier("logreg", label)]).fit(calibration)


def blend_two_scorers(train: DataFrame, scores: list[str], label: str) -> PipelineModel:
    """Logistic blend of two (or 2C) score columns."""
    return Pipeline(stages=[_assembler(scores), classifier("logreg", label)]).fit(train)


def fit_embedding_classifier(train: DataFrame, vec: str, label: str) -> PipelineModel:
    """Standardised vectors into a balanced logistic regression. ``vec`` is array<double>."""
    w = with_class_weight(train, label).withColumn("__raw", array_to_vector(F.col(vec).cast("array<double>")))
    scaler = StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, classifier("logreg", label, "__w", maxIter=50)]).fit(w)


def embedding_predict(model: PipelineModel, df: DataFrame, vec: str) -> DataFrame:
    d = df.withColumn("__raw", array_to_vector(F.col(vec).cast("array<double>")))
    return model.transform(d).select(*df.columns, F.col("prediction"))


def lag_regression_walkforward(lags: DataFrame, by, n_lags: int, y="y", month="month",
                               kinds=("ridge", "rf")) -> DataFrame:
    """Expanding-window validation of regressors on min-max scaled lags, metrics averaged over folds.

    All series train one model per fold (pooled): rows before the fold's cut train, the next
    block tests. Scaling bounds come from the train rows of the fold.
    """
    from visitgrid.operators.regression import regression_metrics
    from visitgrid.operators.sampling import walk_forward_folds
    by = list(by)
    w = Window.partitionBy(*by)
    pos = lags.withColumn("__i", F.row_number().over(w.orderBy(month)) - 1).withColumn(
        "__n", F.count(F.lit(1)).over(w))
    pos = materialize(pos)
    lengths = pos.groupBy(*by).agg(F.max("__n").alias("n"))
    folds = materialize(walk_forward_folds(lengths, n_lags))
    features = [f"lag_{i}" for i in range(1, n_lags + 1)]
    n_folds = folds.agg(F.max("fold")).first()[0] + 1
    scores = None
    for f in range(n_folds):
        j = pos.join(folds.where(F.col("fold") == f), by)
        tr, te = j.where(F.col("__i") < F.col("train_end")), j.where(
            (F.col("__i") >= F.col("train_end")) & (F.col("__i") < F.col("test_end")))
        from pyspark.ml.feature import MinMaxScaler
        for kind in kinds:
            m = Pipeline(stages=[_assembler(features, "__raw"),
                                 MinMaxScaler(inputCol="__raw", outputCol="features"),
                                 regressor(kind, y)]).fit(tr)
            s = m.transform(te).select(F.lit(f"Lag-{kind}").alias("model"), F.lit(f).alias("f"), y,
                                       F.greatest("prediction", F.lit(0.0)).alias("p"))
            scores = s if scores is None else scores.unionByName(s)
    per = regression_metrics(scores, y, "p", ["model", "f"])
    return per.groupBy("model").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"),
                                    F.avg("r2").alias("r2"), F.count(F.lit(1)).alias("folds"))


def best_duration_model(train: DataFrame, new: DataFrame, row_id: str, features, label, days: str,
                        kinds=("ridge", "rf"), k=3, known_days=True):
    """Durations of new rows by the better of the best single model and the stack.

    Models learn log1p days. Train out-of-fold errors decide; the stack wins ties.
    Returns (rows with ``days`` and ``chosen``, error table).
    """
    from visitgrid.operators.regression import from_log, regression_metrics
    kinds = list(kinds)
    oof, meta = stacking_oof(train, row_id, features, label, kinds, k, "reg")
    stacked = predicted(meta, oof, "oof_stack")
    rows = F.array(*[F.struct(F.lit(m).alias("model"), from_log(F.col(f"oof_{m}")).alias("p"))
                     for m in [*kinds, "stack"]])
    errors = regression_metrics(stacked.select(F.expm1(label).alias("y"), F.inline(rows)), "y", "p", ["model"])
    errors = materialize(errors)
    best = errors.orderBy("mae", F.when(F.col("model") == "stack", 0).otherwise(1), "model").first()["model"]
    bases = {m: fit_regressor(train, features, label, m) for m in (kinds if best == "stack" else [best])}
    if best == "stack":
        out = stack_predict(bases, meta, new, "reg", "__lp")
    else:
        out = predicted(bases[best], new, "__lp")
    keep = [c for c in new.columns if c != "days"]
    return out.select(*keep, from_log(F.col("__lp")).alias("days"), F.lit(best).alias("chosen")), errors
