"""Training and scoring queries (rows-only checks, except where the result is closed form or SQL can state what must hold)."""

from pyspark.sql import functions as F

from visitgrid.catalog.registry import query
from visitgrid.functions.core import r6
from visitgrid.operators import evaluate as E
from visitgrid.operators import features as FE
from visitgrid.operators import models as M
from visitgrid.operators import regression as RG
from visitgrid.operators import sampling as S
from visitgrid.operators import series as TS
from visitgrid.operators import tuning as TU
from visitgrid.plans import roles as R
from visitgrid.plans.ordered import materialize

FEATURES = ["p", "p2", "price", "month"]
REG_FEATURES = ["yhat", "yhat2"]


def train_table(spark, sf):
    """Binary rows with four features and a hashed split."""
    o = R.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e5).alias("price"),
        F.month("o_orderdate").cast("double").alias("month"))
    return materialize(S.hash_split(R.scored(spark, sf).join(o, "id"), "id"))


def parts(df):
    return df.where("split = 'train'"), df.where("split = 'test'")


def auc_row(scored, name):
    out = E.roc_auc(scored.withColumn("model", F.lit(name)), "y", "p_hat", ["model"])
    return out.select("model", F.round("roc_auc", 3).alias("roc_auc"))


def reg_table(spark, sf):
    d = R.durations(spark, sf).withColumn("ly", F.log1p("y"))
    return materialize(d)


@query("class_weights", f"""WITH {R.SCORED_SQL}, c AS (SELECT y, count(*) AS n FROM sc GROUP BY 1)
SELECT y, n, round((SELECT sum(n) FROM c)/((SELECT count(*) FROM c)*n),6) AS weight FROM c""")
def _(spark, sf):
    return M.class_weights(R.scored(spark, sf), "y").withColumn("weight", r6("weight"))


@query("fit_majority", f"""WITH {R.SCORED_SQL}, c AS (SELECT y, count(*) AS n FROM sc GROUP BY 1)
SELECT y AS prediction, round(n/(SELECT sum(n) FROM c),6) AS share FROM c ORDER BY n DESC, y LIMIT 1""")
def _(spark, sf):
    return M.fit_majority(R.scored(spark, sf), "y").withColumn("share", r6("share"))


@query("fit_logreg")
def _(spark, sf):
    tr, _ = parts(train_table(spark, sf))
    m = M.fit_classifier(tr, FEATURES, "y", "logreg")
    return M.coefficient_table(m, FEATURES, tr).withColumn("coefficient", F.round("coefficient", 3))


def _fit_auc(spark, sf, kind):
    tr, te = parts(train_table(spark, sf))
    m = M.fit_classifier(tr, FEATURES, "y", kind)
    return auc_row(M.positive_score(m, te, "p_hat"), kind)


@query("fit_rf_classifier")
def _(spark, sf):
    return _fit_auc(spark, sf, "rf")


@query("fit_gbt_classifier")
def _(spark, sf):
    return _fit_auc(spark, sf, "gbt")


def _multi(spark, sf):
    d = R.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("cls"), F.col("l_quantity"), "l_discount", "l_tax",
        F.months_between("l_shipdate", F.lit("1995-01-01")).alias("age"))
    return materialize(S.hash_split(FE.label_encode(d, "cls"), "l_orderkey"))


MULTI_FEATURES = ["l_quantity", "l_discount", "l_tax", "age"]


@query("fit_rf_multiclass")
def _(spark, sf):
    tr, te = parts(_multi(spark, sf))
    m = M.fit_classifier(tr, MULTI_FEATURES, "code", "rf")
    df = M.predicted(m, te).withColumn("prediction", F.col("prediction").cast("long"))
    out = E.multiclass_metrics(df, "code", "prediction")
    return out.select("n", *[F.round(c, 3).alias(c) for c in ("accuracy", "f1_weighted", "f1_macro")])


@query("fit_gbt_multiclass")
def _(spark, sf):
    tr, te = parts(_multi(spark, sf))
    m = M.fit_gbt_multiclass(tr, MULTI_FEATURES, "code")
    df = M.predicted(m, te).withColumn("prediction", F.col("prediction").cast("long"))
    return E.multiclass_metrics(df, "code", "prediction").select("n", F.round("accuracy", 3).alias("accuracy"))


def _reg_metrics(spark, sf, kinds):
    tr, te = parts(reg_table(spark, sf))
    out = None
    for kind in kinds:
        m = M.fit_regressor(tr, REG_FEATURES, "ly", kind)
        s = M.predicted(m, te, "lp").select(F.lit(kind).alias("model"), "y", RG.from_log(F.col("lp")).alias("p"))
        out = s if out is None else out.unionByName(s)
    df = RG.regression_metrics(out, "y", "p", ["model"])
    return df.select("model", "n", *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "r2")])


@query("fit_linear_regressors")
def _(spark, sf):
    return _reg_metrics(spark, sf, ["ridge", "lasso", "elastic"])


@query("fit_tree_regressors")
def _(spark, sf):
    return _reg_metrics(spark, sf, ["rf", "gbt"])


@query("cross_validate")
def _(spark, sf):
    df = M.cross_validate(train_table(spark, sf), "id", FEATURES, "y", kinds=("logreg", "rf", "gbt"), k=3)
    return df.select("model", *[F.round(c, 4).alias(c) for c in ("cv_auc_mean", "cv_auc_std")])


@query("hyperparameter_search")
def _(spark, sf):
    tr, _ = parts(train_table(spark, sf))
    df = M.hyperparameter_search(tr, "id", FEATURES, "y", "logreg", trials=12, k=3)
    return df.select("trial", "params", F.round("score", 3).alias("score"))


@query("rf_importance_prefilter")
def _(spark, sf):
    tr, _ = parts(train_table(spark, sf))
    _, ranked = M.rf_importance_prefilter(tr, FEATURES, "y", 3)
    return ranked.select("feature", F.round("importance", 3).alias("importance"))


@query("consensus_importance")
def _(spark, sf):
    tr, _ = parts(train_table(spark, sf))
    t = M.importance_table(M.fit_classifier(tr, FEATURES, "y", "rf"), FEATURES, "rf", tr).unionByName(
        M.importance_table(M.fit_classifier(tr, FEATURES, "y", "gbt"), FEATURES, "gbt", tr))
    return M.consensus_importance(t, 3).withColumn("importance", F.round("importance", 3))


@query("feature_selection_retrain")
def _(spark, sf):
    tr, te = parts(train_table(spark, sf))
    df = M.feature_selection_retrain(tr, te, FEATURES, "y", top=15, kinds=("rf", "gbt"))
    return df.select("model", F.round("auc_all", 3).alias("auc_all"), F.round("auc_selected", 3).alias("auc_selected"), "n_selected")


@query("permutation_importance")
def _(spark, sf):
    tr, te = parts(train_table(spark, sf))
    df = M.permutation_importance(M.fit_classifier(tr, FEATURES, "y", "logreg"), te, "id", FEATURES, "y")
    return df.withColumn("importance", F.round("importance", 3))


@query("partial_dependence")
def _(spark, sf):
    tr, te = parts(train_table(spark, sf))
    df = M.partial_dependence(M.fit_classifier(tr, FEATURES, "y", "logreg"), te, FEATURES, points=10)
    return df.withColumns({"value": F.round("value", 4), "mean_p": F.round("mean_p", 3)})


@query("ice_sample")
def _(spark, sf):
    tr, te = parts(train_table(spark, sf))
    df = M.ice_sample(M.fit_classifier(tr, FEATURES, "y", "logreg"), te, "id", "p", rows=100, points=5)
    return df.withColumns({"value": F.round("value", 4), "score": F.round("score", 3)})


@query("learning_curve")
def _(spark, sf):
    df = M.learning_curve(train_table(spark, sf), "id", FEATURES, "y")
    return df.withColumns({"auc_mean": F.round("auc_mean", 3), "auc_std": F.round("auc_std", 3)})


@query("stacking_oof")
def _(spark, sf):
    tr, te = parts(reg_table(spark, sf))
    kinds = ["ridge", "rf"]
    _, meta = M.stacking_oof(tr, "id", REG_FEATURES, "ly", kinds, k=3, task="reg")
    bases = {k: M.fit_regressor(tr, REG_FEATURES, "ly", k) for k in kinds}
    s = M.stack_predict(bases, meta, te, "reg", "lp").select("y", RG.from_log(F.col("lp")).alias("p"))
    return RG.regression_metrics(s, "y", "p").select("n", *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "r2")])


@query("best_duration_predict")
def _(spark, sf):
    tr, te = parts(reg_table(spark, sf))
    pred, table = M.best_duration_model(tr, te, "id", REG_FEATURES, "ly", "y", kinds=("ridge", "lasso", "elastic", "rf"), k=3)
    return (pred.groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("days"), 2).alias("mean_days")))


def out_of_fold(spark, sf, kinds):
    """Held-out probabilities of fitted models on all train rows."""
    tr, te = parts(train_table(spark, sf))
    return materialize(M.out_of_fold(tr, "id", FEATURES, "y", kinds)), tr, te


@query("platt_scaling")
def _(spark, sf):
    """The sigmoid map of a forest's scores, learned from its out-of-fold scores."""
    oof, tr, te = out_of_fold(spark, sf, ["rf"])
    scored = M.positive_score(M.fit_classifier(tr, FEATURES, "y", "rf"), te, "oof_rf")
    s = M.positive_score(M.platt_scaling(oof, "oof_rf", "y"), scored, "p_hat")
    return E.calibration_table(s, "y", "p_hat").select("bin", "n", F.round("gap", 3).alias("gap"))


@query("blend_two_scorers")
def _(spark, sf):
    """Two fitted models blended by their out-of-fold scores."""
    oof, tr, te = out_of_fold(spark, sf, ["logreg", "rf"])
    for kind in ("logreg", "rf"):
        te = M.positive_score(M.fit_classifier(tr, FEATURES, "y", kind), te, f"oof_{kind}")
    return auc_row(M.positive_score(M.blend_two_scorers(oof, ["oof_logreg", "oof_rf"], "y"), te, "p_hat"), "blend")


@query("sigmoid_maps", f"""WITH {R.PROBS_SQL} SELECT cls, count(*) AS n, 1 AS balanced FROM cp GROUP BY 1""")
def _(spark, sf):
    """One-vs-rest calibration by Newton's method: at the optimum the smoothed hits of a class are what its
    map expects, and the calibrated probabilities of a row sum to one."""
    p = R.class_probs(spark, sf)
    top = F.col("p") * (0.5 + F.pmod(F.xxhash64("ent_id", "cls"), F.lit(100)) / 100.0)
    rows = materialize(p.withColumn("hit", (top > 0.16).cast("int")))
    maps = materialize(M.sigmoid_maps(rows, "cls", "p", "hit"))
    out = materialize(M.calibrated_classes(rows.select("ent_id", "cls", "p"), maps, "ent_id"))
    off = out.groupBy("ent_id").agg(F.abs(F.sum("p") - 1).alias("d")).agg(F.max("d")).scalar()
    q = 1 / (1 + F.exp(-(F.col("a") * F.col("p") + F.col("b"))))
    per = rows.join(maps, "cls").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"), F.sum(q).alias("e"))
    neg = F.col("n") - F.col("h")
    target = F.col("h") * (F.col("h") + 1) / (F.col("h") + 2) + neg / (neg + 2)
    return per.select("cls", "n", ((F.abs(F.col("e") - target) < 1e-3) & (off < 1e-9)).cast("int").alias("balanced"))


def _class_scores(spark, sf, kinds):
    """(train, test, out-of-fold vectors on train, test with vectors) of the multiclass table."""
    tr, te = parts(_multi(spark, sf))
    tr, te = M.fit_table(tr.withColumn("id", F.monotonically_increasing_id()), ["id", *MULTI_FEATURES, "code"]), te
    oof = materialize(M.out_of_fold_classes(tr, "id", MULTI_FEATURES, "code", kinds))
    for kind in kinds:
        te = M.class_vector(M.fit_classifier(tr, MULTI_FEATURES, "code", kind), te, f"oof_{kind}")
    return tr, oof, te


@query("blend_classes")
def _(spark, sf):
    """Two scorers' probability vectors blended: 2C columns for C classes."""
    _, oof, te = _class_scores(spark, sf, ["logreg", "rf"])
    df = M.predicted(M.blend_classes(oof, ["oof_logreg", "oof_rf"], "code"), te).withColumn("prediction", F.col("prediction").cast("long"))
    return E.multiclass_metrics(df, "code", "prediction").select("n", *[F.round(c, 3).alias(c) for c in ("accuracy", "f1_weighted", "f1_macro")])


@query("stack_classes")
def _(spark, sf):
    """The class stack next to its bases."""
    tr, te = parts(_multi(spark, sf))
    tr = M.fit_table(tr.withColumn("id", F.monotonically_increasing_id()), ["id", *MULTI_FEATURES, "code"])
    bases, meta = M.stack_classes(tr, "id", MULTI_FEATURES, "code", ["logreg", "rf"])
    wide = M.stack_class_predict(bases, meta, te)
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("long").alias("pred")) for n, c in (
        ("stack", "prediction"), *((k, f"prediction_{k}") for k in bases))])
    out = E.multiclass_metrics(wide.select("code", F.inline(rows)), "code", "pred", ["model"])
    return out.select("model", "n", *[F.round(c, 3).alias(c) for c in ("accuracy", "f1_weighted", "f1_macro")])


@query("quantile_forest", f"""WITH {R.DURATIONS_SQL} SELECT count(*) AS n, 1 AS ordered, 1 AS covers FROM du WHERE split='test'""")
def _(spark, sf):
    """P50 and P90 of every test row; about half and nine tenths of the actual values lie below them."""
    tr, te = parts(reg_table(spark, sf))
    q = M.quantile_forest(tr, te.withColumn("rid", F.monotonically_increasing_id()), "rid", REG_FEATURES, "y", {"p50": 0.5, "p90": 0.9}, numTrees=100)
    c = q.agg(F.count(F.lit(1)).alias("n"), F.min((F.col("p50") <= F.col("p90")).cast("int")).alias("ordered"),
              F.avg((F.col("y") <= F.col("p50")).cast("double")).alias("c50"), F.avg((F.col("y") <= F.col("p90")).cast("double")).alias("c90"))
    return c.select("n", "ordered", (F.col("c50").between(0.4, 0.6) & F.col("c90").between(0.83, 0.97)).cast("int").alias("covers"))


@query("resampling_search")
def _(spark, sf):
    """Parameters and SMOTE ratio searched together, resampled inside the folds."""
    tr, _ = parts(train_table(spark, sf))
    tr = M.fit_table(tr, ["id", *FEATURES, "y"])
    df = TU.resampling_search(tr, "id", FEATURES, "y", "logreg", trials=12, k=3)
    return df.select("trial", "params", "ratio", F.round("score", 3).alias("score"))


@query("resampling_search_multiclass")
def _(spark, sf):
    tr, _ = parts(_multi(spark, sf))
    tr = M.fit_table(tr.withColumn("id", F.monotonically_increasing_id()), ["id", *MULTI_FEATURES, "code"])
    df = TU.resampling_search(tr, "id", MULTI_FEATURES, "code", "logreg", trials=6, k=3, metric="f1")
    return df.select("trial", "params", "ratio", F.round("score", 3).alias("score"))


@query("fit_tuned")
def _(spark, sf):
    """The best trial's model, on all train rows resampled at its ratio, against the held-out rows."""
    tr, te = parts(train_table(spark, sf))
    tr = M.fit_table(tr, ["id", *FEATURES, "y"])
    search = materialize(TU.resampling_search(tr, "id", FEATURES, "y", "logreg", trials=12, k=3))
    m, params = TU.fit_tuned(tr, "id", FEATURES, "y", search)
    return auc_row(M.positive_score(m, te, "p_hat"), "tuned" if params else "default")


@query("embedding_classifier")
def _(spark, sf):
    e = materialize(S.hash_split(R.table(spark, sf, "embeddings"), "vec_id"))
    tr, te = parts(e)
    m = M.fit_embedding_classifier(tr, "embedding", "label")
    df = M.embedding_predict(m, te, "embedding").withColumn("prediction", F.col("prediction").cast("int"))
    return E.multiclass_metrics(df, "label", "prediction").select("n", F.round("accuracy", 3).alias("accuracy"))


@query("score_threshold")
def _(spark, sf):
    tr, te = parts(train_table(spark, sf))
    df = M.score_threshold(M.fit_classifier(tr, FEATURES, "y", "logreg"), te, 0.5)
    return df.select("id", F.round("prob_coming", 3).alias("prob_coming"))


@query("lag_regression_walkforward")
def _(spark, sf):
    lags = TS.lag_features(R.monthly(spark, sf), ["series_id"], 6)
    df = M.lag_regression_walkforward(lags, ["series_id"], 6, kinds=("ridge", "rf"))
    return df.select("model", "folds", *[F.round(c, 2).alias(c) for c in ("mae", "rmse", "r2")])
