"""Evaluation, significance and regression queries."""

import re

from pyspark.sql import functions as F

from visitgrid.catalog.registry import query
from visitgrid.functions.core import md5_int, r6
from visitgrid.operators import evaluate as E
from visitgrid.operators import regression as RG
from visitgrid.operators import sampling as S
from visitgrid.operators import significance as SG
from visitgrid.plans import roles as R


def r(df, *cols):
    """Round the named columns to six places."""
    return df.withColumns({c: r6(c) for c in cols})


def long_scores(spark, sf):
    """(id, y, model, p) for two models."""
    s = R.scored(spark, sf)
    rows = F.array(F.struct(F.lit("m1").alias("model"), F.col("p").alias("p")),
                   F.struct(F.lit("m2").alias("model"), F.col("p2").alias("p")))
    return s.select("id", "y", F.inline(rows))


LONG_SQL = f"""{R.SCORED_SQL}, lg AS (SELECT id, y, 'm1' AS model, p FROM sc UNION ALL SELECT id, y, 'm2', p2 FROM sc)"""
CELLS_SQL = f"""{LONG_SQL},
ce AS (SELECT model, p AS score, sum(y) AS pos, count(*)-sum(y) AS neg FROM lg GROUP BY 1,2),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS np,
  sum(neg) OVER (PARTITION BY model) AS nn FROM ce WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
au AS (SELECT model, sum(pos*((nn-fp)+0.5*neg))/(max(np)*max(nn))::DOUBLE AS auc FROM cu GROUP BY 1),
ap AS (SELECT model, sum(pos/np*(tp/(tp+fp))) AS ap FROM cu GROUP BY 1),
f1 AS (SELECT model, score, 2*(tp/(tp+fp))*(tp/np)/((tp/(tp+fp))+(tp/np)+1e-8) AS f FROM cu),
bt AS (SELECT model, CASE WHEN f>0 THEN score ELSE 0.5 END AS thr, f FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY f DESC, score) AS rn FROM f1) WHERE rn=1),
cf AS (SELECT model, sum((y=0 AND p<0.5)::INT) AS tn, sum((y=0 AND p>=0.5)::INT) AS fp, sum((y=1 AND p<0.5)::INT) AS fn,
  sum((y=1 AND p>=0.5)::INT) AS tp, count(*) AS n FROM lg GROUP BY 1)"""
RATES_SQL = ("round((tp+tn)/n,6) AS accuracy, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, "
             "round(2*tp/(2*tp+fp+fn),6) AS f1")


@query("confusion_binary", f"""WITH {CELLS_SQL} SELECT model, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, {RATES_SQL} FROM cf""")
def _(spark, sf):
    df = E.confusion_binary(long_scores(spark, sf), "y", E.at_threshold("p", 0.5), ["model"])
    return r(df, "accuracy", "precision", "recall", "f1")


@query("roc_auc", f"WITH {CELLS_SQL} SELECT model, round(auc,6) AS roc_auc FROM au")
def _(spark, sf):
    return r(E.roc_auc(long_scores(spark, sf), "y", "p", ["model"]), "roc_auc")


@query("average_precision", f"WITH {CELLS_SQL} SELECT model, round(ap,6) AS average_precision FROM ap")
def _(spark, sf):
    return r(E.average_precision(long_scores(spark, sf), "y", "p", ["model"]), "average_precision")


@query("roc_points", f"WITH {CELLS_SQL} SELECT model, score AS threshold, round(fp/nn,6) AS fpr, round(tp/np,6) AS tpr FROM cu")
def _(spark, sf):
    return r(E.roc_points(long_scores(spark, sf), "y", "p", ["model"]), "fpr", "tpr")


@query("pr_points", f"""WITH {CELLS_SQL} SELECT model, score AS threshold, round(tp/(tp+fp),6) AS precision,
  round(tp/np,6) AS recall, round(np/(np+nn),6) AS prevalence FROM cu""")
def _(spark, sf):
    return r(E.pr_points(long_scores(spark, sf), "y", "p", ["model"]), "precision", "recall", "prevalence")


@query("f1_optimal_threshold", f"WITH {CELLS_SQL} SELECT model, thr AS threshold, round(f,6) AS f1 FROM bt")
def _(spark, sf):
    return r(E.f1_optimal_threshold(long_scores(spark, sf), "y", "p", ["model"]), "f1")


_EDGES = [i * 0.1 for i in range(10)] + [1.0]
_CAL = " ".join(f"WHEN p>={_EDGES[i]!r}::DOUBLE AND p<{'=' if i == 9 else ''}{_EDGES[i+1]!r}::DOUBLE THEN {i}" for i in range(10))


@query("calibration_table", f"""WITH {LONG_SQL}, b AS (SELECT model, y, p, CASE {_CAL} END AS bin FROM lg)
SELECT model, bin::BIGINT AS bin, count(*) AS n, round(avg(p),6) AS mean_pred, round(avg(y),6) AS actual_rate, round(abs(avg(p)-avg(y)),6) AS gap
FROM b WHERE bin IS NOT NULL GROUP BY 1,2""")
def _(spark, sf):
    df = E.calibration_table(long_scores(spark, sf), "y", "p", keys=["model"])
    return r(df, "mean_pred", "actual_rate", "gap")


@query("degenerate_check", f"""WITH {LONG_SQL} SELECT model, round(stddev_pop(p),6) AS p_std, min(p) AS p_min, max(p) AS p_max,
  CAST(stddev_pop(p)<1e-6 AS BIGINT) AS degenerate, CAST(min(p)>0.5 AND stddev_pop(p)>=1e-6 AS BIGINT) AS all_positive FROM lg GROUP BY 1""")
def _(spark, sf):
    return r(E.degenerate_check(long_scores(spark, sf), "p", ["model"]), "p_std")


REPORT_SQL = f"""{CELLS_SQL}, rp AS (SELECT cf.model, tp, fp, fn, tn, n AS n_test, {RATES_SQL}, auc AS roc_auc, ap AS average_precision,
  thr AS opt_threshold, f AS f1_opt, CAST((SELECT stddev_pop(p) FROM lg l WHERE l.model=cf.model)<1e-6 AS BIGINT) AS degenerate
  FROM cf JOIN au USING (model) JOIN ap USING (model) JOIN bt USING (model))"""


def report(spark, sf):
    return E.binary_report(long_scores(spark, sf), "y", "p")


@query("binary_report", f"""WITH {REPORT_SQL} SELECT model, tp::BIGINT AS tp, fp::BIGINT AS fp, n_test, accuracy, f1, round(roc_auc,6) AS roc_auc,
  round(average_precision,6) AS average_precision, opt_threshold, round(f1_opt,6) AS f1_opt, degenerate FROM rp""")
def _(spark, sf):
    df = r(report(spark, sf), "accuracy", "f1", "roc_auc", "average_precision", "f1_opt")
    return df.select("model", "tp", "fp", "n_test", "accuracy", "f1", "roc_auc", "average_precision",
                     "opt_threshold", "f1_opt", "degenerate")


@query("rank_models", f"""WITH {REPORT_SQL} SELECT model, round(roc_auc,6) AS roc_auc, CAST(degenerate=0 AND n_test>=500 AS BIGINT) AS eligible,
  row_number() OVER (ORDER BY CAST(degenerate=0 AND n_test>=500 AS BIGINT) DESC, roc_auc DESC, model) AS rank FROM rp""")
def _(spark, sf):
    df = E.rank_models(report(spark, sf))
    return r(df, "roc_auc").select("model", "roc_auc", "eligible", "rank")


@query("model_fallback", f"""WITH {REPORT_SQL}, rk AS (SELECT model, roc_auc, row_number() OVER (ORDER BY roc_auc DESC, model) AS rank FROM rp)
SELECT model, rank, round(roc_auc,6) AS roc_auc FROM rk WHERE model<>(SELECT model FROM rk WHERE rank=1) ORDER BY rank LIMIT 1""")
def _(spark, sf):
    from visitgrid.plans.ordered import materialize
    ranked = materialize(E.rank_models(report(spark, sf)))
    usable = ranked.select("model", (F.col("rank") > 1).cast("long").alias("usable"))
    return r(E.next_usable_model(ranked, usable), "roc_auc")


# -- multiclass -------------------------------------------------------------------

def class_preds(spark, sf):
    """(id, y, pred, pred2): package of each order and two noisy predictions of it."""
    v = R.visits(spark, sf).where(F.col("umr_art").isNotNull()).select("visit_id", "umr_art")
    n = len(R.PACKAGES)
    pk = F.array(*[F.lit(p.replace(", ", ",")) for p in R.PACKAGES])

    def noisy(tag, share):
        h = md5_int(F.concat("visit_id", F.lit(tag)))
        return F.when(h % 100 < share, F.get(pk, (h % n).cast("int"))).otherwise(F.col("y"))

    v = v.select("visit_id", F.array_join(F.sort_array(F.split("umr_art", ",")), ",").alias("y"))
    return v.select(F.col("visit_id").alias("id"), "y", noisy("p", 40).alias("pred"), noisy("q", 60).alias("pred2"))


_PK = "[" + ",".join("'" + p.replace(", ", ",") + "'" for p in R.PACKAGES) + "]"


def _noisy(tag, share):
    h = R.MD5.format(f"visit_id||'{tag}'")
    return f"CASE WHEN {h}%100<{share} THEN ({_PK})[{h}%7+1] ELSE y END"


PREDS_SQL = f"""{R.VISITS_SQL}, pv AS (SELECT visit_id, array_to_string(list_sort(string_split(umr_art,',')),',') AS y FROM vis WHERE umr_art IS NOT NULL),
mp AS (SELECT visit_id AS id, y, {_noisy('p', 40)} AS pred, {_noisy('q', 60)} AS pred2 FROM pv)"""


def _per_class_sql(src="mp", where="TRUE"):
    return f"""pc AS (SELECT k.class, count(*) FILTER (y=k.class) AS support, count(*) FILTER (pred=k.class) AS np,
  count(*) FILTER (y=k.class AND pred=k.class) AS tp FROM {src}, (SELECT y AS class FROM {src} UNION SELECT pred FROM {src}) k WHERE {where} GROUP BY 1),
pf AS (SELECT *, coalesce(2*tp/nullif(support+np,0),0) AS f1 FROM pc)"""


@query("multiclass_metrics", f"""WITH {PREDS_SQL}, {_per_class_sql()}
SELECT sum(support)::BIGINT AS n, round(sum(tp)/sum(support),6) AS accuracy, round(sum(f1*support)/sum(support),6) AS f1_weighted, round(avg(f1),6) AS f1_macro FROM pf""")
def _(spark, sf):
    return r(E.multiclass_metrics(class_preds(spark, sf), "y", "pred"), "accuracy", "f1_weighted", "f1_macro")


@query("per_class_report", f"""WITH {PREDS_SQL}, {_per_class_sql()}
SELECT class, support, tp, round(coalesce(tp/nullif(np,0),0),6) AS precision, round(coalesce(tp/nullif(support,0),0),6) AS recall, round(f1,6) AS f1 FROM pf""")
def _(spark, sf):
    df = E.per_class_report(E.class_cells(class_preds(spark, sf), "y", "pred"))
    return r(df, "precision", "recall", "f1")


@query("ovr_weighted_auc", f"""WITH {R.PROBS_SQL}, tr AS (SELECT ent_id, arg_min(cls, {R.MD5.format("ent_id||cls||'t'")}) AS actual FROM cp GROUP BY 1),
d AS (SELECT cls, round(p,2) AS p, (actual=cls)::INT AS hit FROM cp JOIN tr USING (ent_id)),
c AS (SELECT cls, p, sum(hit) AS pos, count(*)-sum(hit) AS neg FROM d GROUP BY 1,2),
u AS (SELECT *, sum(neg) OVER (PARTITION BY cls ORDER BY p DESC) AS fp, sum(neg) OVER (PARTITION BY cls) AS nn FROM c),
a AS (SELECT cls, sum(pos*(nn-fp+0.5*neg))/(sum(pos)*max(nn)) AS auc, sum(pos) AS np FROM u GROUP BY 1)
SELECT round(sum(auc*np)/sum(np),6) AS auc_ovr_weighted FROM a""")
def _(spark, sf):
    cp = R.class_probs(spark, sf)
    truth = cp.groupBy("ent_id").agg(F.min_by("cls", md5_int(F.concat("ent_id", "cls", F.lit("t")))).alias("actual"))
    # one row per entity on the right: merged in ranges, never sent whole to every task
    d = cp.withColumn("p", F.round("p", 2)).join(truth.hint("merge"), "ent_id")
    return r(E.ovr_weighted_auc(d, "actual", "cls", "p"), "auc_ovr_weighted")


@query("confusion_multiclass", f"""WITH {PREDS_SQL} SELECT y AS actual, {", ".join(
    f"count(*) FILTER (pred='{p.replace(', ', ',')}') AS \"{p.replace(', ', ',')}\"" for p in R.PACKAGES)} FROM mp GROUP BY 1""")
def _(spark, sf):
    return E.confusion_multiclass(class_preds(spark, sf), "y", "pred", [p.replace(", ", ",") for p in R.PACKAGES])


@query("agreement_matrix", f"""WITH {PREDS_SQL} """ + " UNION ALL ".join(
    f"SELECT '{a}' AS model_a, '{b}' AS model_b, round(avg(({a}={b})::INT),6) AS agreement FROM mp"
    for a in ("y", "pred", "pred2") for b in ("y", "pred", "pred2")))
def _(spark, sf):
    return r(E.agreement_matrix(class_preds(spark, sf), ["y", "pred", "pred2"]), "agreement")


@query("min_support_sensitivity", f"""WITH {R.WIDE_SQL}, sp AS (SELECT id, cls AS y, CASE WHEN {R.MD5.format("id||'p'")}%100<40 THEN string_split(cls,', ')[1] ELSE cls END AS pred,
  {R.MD5.format('id')}%100<20 AS test FROM wp), tr AS (SELECT y, count(*) AS support FROM sp WHERE NOT test GROUP BY 1),
te AS (SELECT sp.y, pred, coalesce(support,0) AS support FROM sp LEFT JOIN tr ON sp.y=tr.y WHERE test),
th AS (SELECT unnest([1,2,3,5,10,20,50]) AS min_support),
x AS (SELECT min_support, y, pred FROM te, th WHERE support>=min_support),
pc AS (SELECT x.min_support, k.class, count(*) FILTER (y=k.class) AS support, count(*) FILTER (pred=k.class) AS np,
  count(*) FILTER (y=k.class AND pred=k.class) AS tp FROM x JOIN (SELECT min_support, y AS class FROM x UNION SELECT min_support, pred FROM x) k
  ON x.min_support=k.min_support GROUP BY 1,2),
pf AS (SELECT *, coalesce(2*tp/nullif(support+np,0),0) AS f1 FROM pc)
SELECT min_support::BIGINT AS min_support, sum(support)::BIGINT AS n_test, round(sum(f1*support)/sum(support),6) AS f1_weighted, round(avg(f1),6) AS f1_macro,
  round(sum(tp)/sum(support),6) AS accuracy FROM pf GROUP BY 1 HAVING sum(support)>=2""")
def _(spark, sf):
    w = R.wide_packages(spark, sf)
    first = F.get(F.split("cls", ", "), F.lit(0))
    p = S.hash_split(w, "id").withColumn(
        "pred", F.when(md5_int(F.concat("id", F.lit("p"))) % 100 < 40, first).otherwise(F.col("cls")))
    te = E.with_support(p.where("split = 'test'"), p.where("split = 'train'"), "cls")
    return r(E.min_support_sensitivity(te, "cls", "pred"), "f1_weighted", "f1_macro", "accuracy")


# -- paired tests and bootstrap ----------------------------------------------------

BIN_SQL = f"""{R.SCORED_SQL}, bp AS (SELECT y, (p>=0.5)::INT AS m1, (p2>=0.5)::INT AS m2, (0.5*p+0.5*p2>=0.5)::INT AS m3 FROM sc)"""


def binary_preds(spark, sf):
    s = R.scored(spark, sf)
    return s.select("y", (F.col("p") >= 0.5).cast("long").alias("m1"), (F.col("p2") >= 0.5).cast("long").alias("m2"),
                    (0.5 * F.col("p") + 0.5 * F.col("p2") >= 0.5).cast("long").alias("m3"))


def _mc_sql(a, b):
    return f"""SELECT '{a}' AS model_a, '{b}' AS model_b, count(*) FILTER ({a}<>y AND {b}=y) AS b, count(*) FILTER ({a}=y AND {b}<>y) AS c FROM bp"""


def _mcnemar_sql(pairs):
    return f"""WITH {BIN_SQL}, d AS ({" UNION ALL ".join(_mc_sql(a, b) for a, b in pairs)}),
t AS (SELECT *, b+c AS n, least(b,c) AS m FROM d),
p AS (SELECT model_a, model_b, b, c, n, CASE WHEN n=0 THEN 1.0 ELSE least(1.0, 2*(SELECT sum(exp(lgamma(t.n+1)-lgamma(k+1)-lgamma(t.n-k+1)-t.n*ln(2)))
  FROM (SELECT unnest(range(t.m+1)) AS k))) END AS pv FROM t)
SELECT model_a, model_b, b, c, round((abs(b-c)-1)**2/greatest(n,1),6) AS chi2, round(pv,5) AS p_value, CAST(pv<0.05 AS BIGINT) AS significant FROM p"""


def _mc_out(df):
    return r(df, "chi2").withColumn("p_value", F.round("p_value", 5) + F.lit(0.0))


@query("mcnemar", _mcnemar_sql([("m1", "m2")]))
def _(spark, sf):
    return _mc_out(SG.mcnemar(binary_preds(spark, sf), "y", [("m1", "m2")]))


@query("pairwise_mcnemar", _mcnemar_sql([("m1", "m2"), ("m1", "m3"), ("m2", "m3")]))
def _(spark, sf):
    return _mc_out(SG.pairwise_mcnemar(binary_preds(spark, sf), "y", ["m1", "m2", "m3"]))


@query("winner_vs_all", _mcnemar_sql([("m3", "m1"), ("m3", "m2")]))
def _(spark, sf):
    return _mc_out(SG.winner_vs_all(binary_preds(spark, sf), "y", "m3", ["m1", "m2", "m3"]))


_NB, _NB_MULTI = 2000, 1000
_DRAW = S.draw("s", "b")
_POIS = "+".join(f"(m>={c})::INT" for c in S.POISSON_LIMITS)
BOOT_CTES = f"""bw AS (SELECT b, y, p, {_POIS} AS w FROM (SELECT b, y, p, {_DRAW} AS m FROM (SELECT *, {R.MD5.format('id')} AS s FROM sc), (SELECT unnest(range({_NB})) AS b))),
bc AS (SELECT b, p, sum(w*y) AS pos, sum(w*(1-y)) AS neg FROM bw WHERE w>0 GROUP BY 1,2),
bu AS (SELECT *, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp, sum(pos) OVER (PARTITION BY b) AS np, sum(neg) OVER (PARTITION BY b) AS nn
  FROM bc WINDOW v AS (PARTITION BY b ORDER BY p DESC)),
bm AS (SELECT b, sum(pos*(nn-fp+0.5*neg))/(max(np)*max(nn)) AS roc_auc, sum(pos/np*(tp/(tp+fp))) AS average_precision,
  2*sum(pos) FILTER (p>=0.5)/(sum(pos) FILTER (p>=0.5)+sum(neg) FILTER (p>=0.5)+max(np)) AS f1 FROM bu GROUP BY 1)"""


def _ci_sql(m):
    return f"""SELECT '{m}' AS metric, count(*) AS n_boot, round(stddev_pop({m}),6) AS std, round(quantile_cont({m},0.025),6) AS ci_lo,
  round(quantile_cont({m},0.975),6) AS ci_hi FROM bm"""


_POINTS = {"roc_auc": "(SELECT auc FROM au WHERE model='m1')", "average_precision": "(SELECT ap FROM ap WHERE model='m1')",
           "f1": "(SELECT 2*tp/(2*tp+fp+fn) FROM cf WHERE model='m1')"}


@query("bootstrap_ci", f"WITH {CELLS_SQL}, {BOOT_CTES} SELECT z.*, round(CASE metric " + " ".join(
    f"WHEN '{m}' THEN {v}" for m, v in _POINTS.items()) + " END,6) AS point FROM (" + " UNION ALL ".join(_ci_sql(m) for m in _POINTS) + ") z")
def _(spark, sf):
    return r(SG.bootstrap_ci(R.scored(spark, sf), "id", "y", "p", n_boot=_NB), "std", "ci_lo", "ci_hi", "point")


def _boot_ctes(tag, score):
    """The replicate metrics of one score column, under names of their own."""
    out = BOOT_CTES.replace("FROM sc)", f"FROM (SELECT id, y, {score} AS p FROM sc))")
    for name in ("bw", "bc", "bu", "bm"):
        out = re.sub(rf"\b{name}\b", f"{name}{tag}", out)
    return out


def _span(m, tag):
    return ", ".join(f"round(quantile_cont({c},{q}),6) AS {c}_{side}" for c in ("roc_auc", "average_precision", "f1")
                     for side, q in (("lo", 0.025), ("hi", 0.975)))


@query("final_ranking", f"""WITH {REPORT_SQL}, {_boot_ctes(1, 'p')}, {_boot_ctes(2, 'p2')},
rr AS (SELECT model, 0.5*roc_auc+0.5*f1_opt AS composite, row_number() OVER (ORDER BY 0.5*roc_auc+0.5*f1_opt DESC, model) AS rank FROM rp),
ci AS (SELECT 'm1' AS model, {_span('m1', 1)} FROM bm1 UNION ALL SELECT 'm2', {_span('m2', 2)} FROM bm2),
bp AS (SELECT y, (p>=0.5)::INT AS m1, (p2>=0.5)::INT AS m2 FROM sc),
dc AS (SELECT count(*) FILTER (m1<>y AND m2=y) AS b12, count(*) FILTER (m1=y AND m2<>y) AS c12 FROM bp),
mc AS (SELECT 'm2' AS model, b12 AS b, c12 AS c FROM dc WHERE (SELECT model FROM rr WHERE rank=1)='m1'
  UNION ALL SELECT 'm1', c12, b12 FROM dc WHERE (SELECT model FROM rr WHERE rank=1)='m2')
SELECT rr.model, round(composite,6) AS composite, rank, (rank=1)::BIGINT AS winner, ci.* EXCLUDE (model), mc.b, mc.c
FROM rr JOIN ci ON rr.model=ci.model LEFT JOIN mc ON rr.model=mc.model""")
def _(spark, sf):
    """The ranking with intervals and the winner's discordant counts; p-values are checked by ``mcnemar``."""
    df = SG.final_comparison(long_scores(spark, sf), "id", n_boot=_NB)
    spans = [f"{m}_{side}" for m in ("roc_auc", "average_precision", "f1") for side in ("lo", "hi")]
    return r(df, "composite", *spans).select("model", "composite", "rank", "winner", *spans, "b", "c")


_MB = f"""{PREDS_SQL}, bw AS (SELECT b, y, pred, {_POIS} AS w FROM (SELECT b, y, pred, {_DRAW} AS m FROM (SELECT *, {R.MD5.format('id')} AS s FROM mp), (SELECT unnest(range({_NB_MULTI})) AS b))),
ce AS (SELECT b, y, pred, sum(w) AS n FROM bw WHERE w>0 GROUP BY ALL),
sd AS (SELECT b, y AS class, n AS support, 0 AS np, CASE WHEN y=pred THEN n ELSE 0 END AS tp FROM ce UNION ALL SELECT b, pred, 0, n, 0 FROM ce),
pf AS (SELECT b, class, sum(support) AS support, sum(tp) AS tp, coalesce(2*sum(tp)/nullif(sum(support)+sum(np),0),0) AS f1 FROM sd GROUP BY 1,2),
bm AS (SELECT b, sum(tp)/sum(support) AS accuracy, sum(f1*support)/sum(support) AS f1_weighted, avg(f1) AS f1_macro FROM pf GROUP BY 1)"""


@query("bootstrap_multiclass", f"WITH {_MB} " + " UNION ALL ".join(_ci_sql(m) for m in ("accuracy", "f1_weighted", "f1_macro")))
def _(spark, sf):
    return r(SG.bootstrap_multiclass(class_preds(spark, sf), "id", "y", "pred", n_boot=_NB_MULTI), "std", "ci_lo", "ci_hi")


def _run_sql(name, odd):
    """AUC per model on the rows of one run."""
    return f"""{name}c AS (SELECT model, p AS score, sum(y) AS pos, count(*)-sum(y) AS neg FROM lg WHERE id%2={odd} GROUP BY 1,2),
{name}u AS (SELECT *, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn
  FROM {name}c WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
{name} AS (SELECT model, sum(pos*((nn-fp)+0.5*neg))/(max(np)*max(nn))::DOUBLE AS auc FROM {name}u GROUP BY 1)"""


@query("compare_two_runs", f"""WITH {LONG_SQL}, {_run_sql('ra', 0)}, {_run_sql('rb', 1)}
SELECT ra.model, round(ra.auc,6) AS run_a, round(rb.auc,6) AS run_b, round(rb.auc-ra.auc,6)+0.0 AS delta,
  CASE WHEN rb.auc>ra.auc THEN '+' WHEN rb.auc<ra.auc THEN '-' ELSE '=' END AS change FROM ra JOIN rb USING (model)""")
def _(spark, sf):
    """Two evaluation runs, each on rows of its own."""
    lg = long_scores(spark, sf)
    a, b = (E.roc_auc(lg.where(F.col("id") % 2 == odd), "y", "p", ["model"]) for odd in (0, 1))
    return r(SG.compare_two_runs(a, b), "run_a", "run_b", "delta")


@query("weighted_vote", f"""WITH {CELLS_SQL}, w AS (SELECT model, auc/sum(auc) OVER () AS w FROM au)
SELECT id, round(sum(w*p),6) AS p, CAST(sum(w*p)>0.5 AS BIGINT) AS prediction FROM lg JOIN w USING (model) GROUP BY 1""")
def _(spark, sf):
    lg = long_scores(spark, sf)
    return r(SG.weighted_vote(lg.select("id", "model", "p"), E.roc_auc(lg, "y", "p", ["model"])), "p")


@query("soft_vote_fit", f"""WITH {LONG_SQL} SELECT id, round(avg(p),6) AS p, CAST(avg(p)>0.5 AS BIGINT) AS prediction FROM lg GROUP BY 1""")
def _(spark, sf):
    from visitgrid.operators.models import soft_vote
    return r(soft_vote(long_scores(spark, sf), "id"), "p")


_RUNS = """runs AS (SELECT o_orderpriority AS task, o_orderstatus AS source, 'm'||o_orderstatus AS model, avg(o_totalprice) AS metric,
  (o_orderpriority<'3')::INT AS lower FROM orders GROUP BY ALL)"""


@query("champion_by_task", f"""WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN lower=1 THEN -metric ELSE metric END DESC, source) AS rn FROM runs)
SELECT task, source, model, round(metric,4) AS metric FROM r WHERE rn=1""")
def _(spark, sf):
    runs = (R.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("source"))
            .agg(F.avg("o_totalprice").alias("metric"))
            .withColumns({"model": F.concat(F.lit("m"), "source"), "lower": (F.col("task") < "3").cast("int")}))
    return SG.champion_by_task(runs).select("task", "source", "model", F.round("metric", 4).alias("metric"))


@query("cross_target_comparison", f"""WITH {R.DURATIONS_SQL}, t AS (SELECT 'a' AS target, type AS model, avg(abs(y-yhat)) AS mae FROM du GROUP BY 2
  UNION ALL SELECT 'b', type, avg(abs(y-yhat2)) FROM du GROUP BY 2)
SELECT target, model, round(mae,6) AS mae, row_number() OVER (ORDER BY mae, model) AS rank FROM t""")
def _(spark, sf):
    d = R.durations(spark, sf)
    t = [RG.regression_metrics(d, "y", c, ["type"]).select(F.lit(n).alias("target"), F.col("type").alias("model"), "mae")
         for n, c in (("a", "yhat"), ("b", "yhat2"))]
    return r(SG.cross_target_comparison(t, "mae", True), "mae")


# -- regression --------------------------------------------------------------------

REG = "round(avg(abs(y-yhat)),6) AS mae, round(sqrt(avg((y-yhat)**2)),6) AS rmse, round(1-sum((y-yhat)**2)/(var_pop(y)*count(*)),6) AS r2"


@query("regression_metrics", f"WITH {R.DURATIONS_SQL} SELECT split, count(*) AS n, {REG} FROM du GROUP BY 1")
def _(spark, sf):
    return r(RG.regression_metrics(R.durations(spark, sf), "y", "yhat", ["split"]), "mae", "rmse", "r2")


def _bin_sql(c):
    return f"CASE WHEN {c}>=0 AND {c}<7 THEN 'Short (<7d)' WHEN {c}>=7 AND {c}<30 THEN 'Medium (7-30d)' WHEN {c}>=30 THEN 'Long (>30d)' END"


@query("duration_bins", f"""WITH {R.DURATIONS_SQL}, b AS (SELECT {_bin_sql('y')} AS bin, 1 AS a, 0 AS p FROM du UNION ALL SELECT {_bin_sql('yhat')}, 0, 1 FROM du)
SELECT bin, sum(a)::BIGINT AS n_actual, sum(p)::BIGINT AS n_predicted FROM b GROUP BY 1""")
def _(spark, sf):
    return RG.duration_bins(R.durations(spark, sf), "y", "yhat")


@query("duration_bin_metrics", f"""WITH {R.DURATIONS_SQL}, bb AS (SELECT {_bin_sql('y')} AS y, {_bin_sql('yhat')} AS pred FROM du), {_per_class_sql('bb')}
SELECT sum(support)::BIGINT AS n, round(sum(tp)/sum(support),6) AS accuracy, round(sum(f1*support)/sum(support),6) AS f1_weighted, round(avg(f1),6) AS f1_macro FROM pf""")
def _(spark, sf):
    return r(RG.duration_bin_metrics(R.durations(spark, sf), "y", "yhat"), "accuracy", "f1_weighted", "f1_macro")


@query("residual_stats", f"""WITH {R.DURATIONS_SQL}, q AS (SELECT quantile_cont(y-yhat,0.5) AS m, quantile_cont(y-yhat,0.1) AS lo, quantile_cont(y-yhat,0.9) AS hi FROM du)
SELECT round(any_value(m),6) AS median, round(stddev_pop(y-yhat),6) AS std, round(any_value(lo),6) AS p10, round(any_value(hi),6) AS p90,
  round(avg(abs(y-yhat)),6) AS mae, round(avg(abs(y-CASE WHEN abs(m)>1 THEN greatest(yhat+m,0) ELSE yhat END)),6) AS mae_corrected FROM du, q""")
def _(spark, sf):
    df = RG.residual_stats(R.durations(spark, sf), "y", "yhat").drop("coverage_80")
    return r(df, *df.columns)


@query("interval_coverage", f"""WITH {R.DURATIONS_SQL}, q AS (SELECT quantile_cont(y-yhat,0.1) AS lo, quantile_cont(y-yhat,0.9) AS hi FROM du)
SELECT round(avg((y>=greatest(yhat+lo,0) AND y<=greatest(yhat+hi,0))::INT),3) AS coverage_80 FROM du, q""")
def _(spark, sf):
    df = RG.residual_stats(R.durations(spark, sf), "y", "yhat")
    return df.select(F.round("coverage_80", 3).alias("coverage_80"))


@query("error_by_type", f"""WITH {R.DURATIONS_SQL}, t AS (SELECT type, count(*) AS n_train FROM du WHERE split='train' GROUP BY 1)
SELECT du.type, count(*) AS n_test, round(avg(abs(y-yhat)),6) AS mae, round(quantile_cont(abs(y-yhat),0.5),6) AS median_abs_error,
  any_value(n_train) AS n_train FROM du JOIN t ON du.type=t.type WHERE split='test' GROUP BY 1 ORDER BY avg(abs(y-yhat)) DESC LIMIT 15""")
def _(spark, sf):
    d = R.durations(spark, sf)
    df = RG.error_by_type(d.where("split='test'"), d.where("split='train'"), "type", "y", "yhat", top=15)
    return r(df, "mae", "median_abs_error")


@query("outlier_impact", f"""WITH {R.DURATIONS_SQL}, h AS (SELECT floor(y*4)/4 AS y, floor(yhat*4)/4 AS yhat FROM du), e AS (SELECT *, abs(y-yhat) AS e FROM h),
c AS (SELECT unnest([0,1,2,5,10]) AS excl_pct, unnest(quantile_cont(e,[1.0,0.99,0.98,0.95,0.9])) AS cut FROM e)
SELECT excl_pct::BIGINT AS excl_pct, count(*) AS n_kept, {REG} FROM e, c WHERE e<=cut GROUP BY 1""")
def _(spark, sf):
    # quarter days are exact doubles, so ties at the cut-off are the same in both engines
    d = R.durations(spark, sf).select(*[(F.floor(F.col(c) * 4) / 4.0).alias(c) for c in ("y", "yhat")])
    return r(RG.outlier_impact(d, "y", "yhat"), "mae", "rmse", "r2")


@query("min_support_regression", f"""WITH {R.DURATIONS_SQL}, tr AS (SELECT part, count(*) AS s FROM du WHERE split='train' GROUP BY 1),
te AS (SELECT y, yhat, coalesce(s,0) AS s FROM du LEFT JOIN tr ON du.part=tr.part WHERE split='test'), th AS (SELECT unnest([1,2,3,5,10,20,50]) AS min_support)
SELECT min_support::BIGINT AS min_support, count(*) AS n_test, {REG} FROM te, th WHERE s>=min_support GROUP BY 1 HAVING count(*)>=2""")
def _(spark, sf):
    d = R.durations(spark, sf)
    te = E.with_support(d.where("split='test'"), d.where("split='train'"), "part")
    return r(RG.min_support_regression(te, "y", "yhat"), "mae", "rmse", "r2")


@query("group_quantiles", f"""WITH {R.DURATIONS_SQL}, q AS (SELECT type, quantile_cont(y,0.5) AS p50, quantile_cont(y,0.9) AS p90 FROM du WHERE split='train' GROUP BY 1)
SELECT du.type, round(any_value(p50),6) AS p50, round(any_value(p90),6) AS p90, count(*) AS n_test, round(avg((y<=p50)::INT),6) AS coverage_p50,
  round(avg((y<=p90)::INT),6) AS coverage_p90 FROM du JOIN q ON du.type=q.type WHERE split='test' GROUP BY 1""")
def _(spark, sf):
    # quarter days are exact doubles, so rows at a quantile count alike in both engines
    d = R.durations(spark, sf)
    return r(RG.group_quantiles(d.where("split='train'"), d.where("split='test'"), "type", "y"), "p50", "p90", "coverage_p50", "coverage_p90")


# the tail of the normal law by the same published fit
_COEF = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
_POLY = "0.0::DOUBLE"
for _k in reversed(_COEF):
    _POLY = f"({_POLY}*t+({_k}::DOUBLE))"


@query("breusch_pagan", f"""WITH {R.DURATIONS_SQL}, c AS (SELECT count(*) AS n, corr((y-yhat)**2, yhat) AS c FROM du), l AS (SELECT n, n*c*c AS lm, sqrt(n*c*c)/sqrt(2.0::DOUBLE) AS x FROM c),
t AS (SELECT *, 1.0::DOUBLE/(1.0+0.5*x) AS t FROM l)
SELECT n, round(lm,4) AS lm, round(t*exp(-x*x+{_POLY}),6)+0.0 AS p_value FROM t""")
def _(spark, sf):
    df = RG.breusch_pagan(R.durations(spark, sf), "y", "yhat")
    return df.select("n", F.round("lm", 4).alias("lm"), r6("p_value").alias("p_value"))


@query("residual_histogram", f"""WITH {R.DURATIONS_SQL}, x AS (SELECT y-yhat AS v FROM du), e AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
SELECT least(floor(30*(v-lo)/(hi-lo))::BIGINT+1, 30) AS bin, count(*) AS n FROM x, e GROUP BY 1""")
def _(spark, sf):
    return RG.residual_histogram(R.durations(spark, sf), "y", "yhat")


@query("qq_points", f"""WITH {R.DURATIONS_SQL}, c AS (SELECT y-yhat AS residual, count(*) AS n FROM du GROUP BY 1)
SELECT round(residual,6)+0.0 AS residual, n, round((sum(n) OVER (ORDER BY c.residual)-n/2.0)/sum(n) OVER (),6) AS prob FROM c""")
def _(spark, sf):
    """The quantiles of the normal law at ``prob`` are tested by hand: SQL has none."""
    return r(RG.qq_points(R.durations(spark, sf), "y", "yhat"), "prob", "residual").select("residual", "n", "prob")


_NU = "({m}+0.5)/4294967296.0::DOUBLE"


def _normal_sql(i):
    u, v = (_NU.format(m=R.MD5.format(f"id||'-'||sg||'-{i}{t}'")) for t in ("", "-b"))
    return f"sqrt(-2.0::DOUBLE*ln({u}))*cos(6.283185307179586::DOUBLE*({v}))"


@query("noise_stability", f"""WITH {R.DURATIONS_SQL}, d AS (SELECT id, split, y, ln(1+y) AS ly, ln(1+yhat) AS a, ln(1+yhat2) AS b FROM du),
mo AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a,b) AS ab, covar_pop(a,ly) AS ay, covar_pop(b,ly) AS byy, avg(a) AS ma, avg(b) AS mb, avg(ly) AS my FROM d WHERE split='train'),
co AS (SELECT (ay*bb-byy*ab)/(aa*bb-ab*ab) AS ka, (byy*aa-ay*ab)/(aa*bb-ab*ab) AS kb, ma, mb, my FROM mo),
st AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM d WHERE split='test'),
n AS (SELECT d.*, sg, ka, kb, my-ka*ma-kb*mb AS k0, a+{_normal_sql(0)}*sg*greatest(sa,1e-8) AS na, b+{_normal_sql(1)}*sg*greatest(sb,1e-8) AS nb
  FROM d, co, st, (SELECT unnest([0.01,0.02,0.05,0.1])::DOUBLE AS sg) WHERE split='test'),
e AS (SELECT sg, avg(abs(y-greatest(exp(k0+ka*a+kb*b)-1,0))) AS x, avg(abs(y-greatest(exp(k0+ka*na+kb*nb)-1,0))) AS z FROM n GROUP BY 1)
SELECT sg AS sigma, round(x,5) AS base_mae, round(z,5) AS noisy_mae, round(z-x,5)+0.0 AS delta_mae FROM e""")
def _(spark, sf):
    """A linear stack of two predictions, fitted on train rows, under noise on test rows."""
    d = R.durations(spark, sf).select("id", "split", "y", F.log1p("y").alias("ly"), F.log1p("yhat").alias("a"), F.log1p("yhat2").alias("b"))
    coef, intercept = RG.fitted_pair(d.where("split = 'train'"), "ly", "a", "b")
    df = RG.noise_stability(d.where("split = 'test'"), "id", "y", ["a", "b"], coef, intercept)
    return df.select("sigma", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("base_mae", "noisy_mae", "delta_mae")])
