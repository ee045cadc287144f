"""Scoring, dating, calibration, backtest and export queries."""

from pyspark.sql import functions as F

from visitgrid import columns as C
from visitgrid.catalog.cleansing import DUR, day
from visitgrid.catalog.registry import query
from visitgrid.catalog.stages import Stages
from visitgrid.catalog.tables import BOTH_SQL, GAPS_SQL, LABELLED_SQL, TYPE_GROUP_SQL, sql_month, type_mapping
from visitgrid.functions.core import floor_days, md5_int, r6
from visitgrid.operators import aggregates as A
from visitgrid.operators import bundle as BU
from visitgrid.operators import cleanse as K
from visitgrid.operators import features as FE
from visitgrid.operators import forecast as FC
from visitgrid.operators import joins as J
from visitgrid.plans import roles as R
from visitgrid.plans.ordered import checkpoint_dir, discrete_quantiles, materialize
from visitgrid.sources.reuse import ResultStore

# Example sets for the ranking penalties.
TYPICAL = {"GERMANY": {"A"}, "FRANCE": {"N", "R"}, "CHINA": {"R"}}
FORBIDDEN = {"3": {"R"}, "1": {"A"}}

UN_SQL = f"""{LABELLED_SQL}, un AS (SELECT *, coalesce(derivat,'UNKNOWN') AS derivat_clean,
  {R.MD5.format("ent_id||'pc'")}%10000/10000.0::DOUBLE AS prob_coming FROM lb
  WHERE came_for_retrofit=0 AND (rueckgabe_soll IS NULL OR rueckgabe_soll>=TIMESTAMP '{R.AS_OF}' - INTERVAL 6 MONTH)),
wl AS (SELECT * FROM un WHERE prob_coming>=0.05)"""


def unseen(st):
    df = K.clean_categoricals(FC.select_unseen(st.labelled, R.AS_OF), ["derivat"])
    return df.withColumn("prob_coming", md5_int(F.concat("ent_id", F.lit("pc"))) % 10000 / F.lit(10000.0))


def will_come(st):
    return unseen(st).where(F.col("prob_coming") >= C.FORECAST_THRESHOLD)


@query("select_unseen", f"WITH {UN_SQL} SELECT ent_id, derivat_clean, prob_coming FROM un")
def _(spark, sf):
    st = Stages(spark, sf)
    return unseen(st).select("ent_id", "derivat_clean", "prob_coming")


@query("threshold_filter", f"WITH {UN_SQL} SELECT ent_id, prob_coming FROM wl")
def _(spark, sf):
    st = Stages(spark, sf)
    return will_come(st).select("ent_id", "prob_coming")


@query("build_scoring_matrix", f"""WITH {UN_SQL}, e AS (SELECT bo AS k, avg(came_for_retrofit) AS enc, count(*)/(SELECT count(*) FROM lb)::DOUBLE AS share FROM lb GROUP BY 1)
SELECT ent_id, round(coalesce(enc,(SELECT avg(came_for_retrofit) FROM lb)),6) AS enc_bo, round(coalesce(share,0),6) AS bo_freq,
  round((SELECT avg(came_for_retrofit) FROM lb),6) AS enc_absent, coalesce(c_acctbal,0) AS num_c_acctbal, 0.0::DOUBLE AS num_absent,
  round(c_acctbal*prob_coming,6)+0.0 AS "ix_c_acctbal_prob_coming" FROM un LEFT JOIN e ON un.bo=e.k""")
def _(spark, sf):
    st = Stages(spark, sf)
    lb = st.labelled
    enc = FE.fit_target_means(lb, ["bo"], C.LABEL)
    freq = FE.fit_frequencies(lb, ["bo"])
    g = FE.global_mean(enc)
    df = FC.build_scoring_matrix(unseen(st), enc, freq, ["bo", "absent"], ["c_acctbal", "absent"], g,
                                 [("c_acctbal", "prob_coming")])
    return df.select("ent_id", r6("enc_bo").alias("enc_bo"), r6("bo_freq").alias("bo_freq"), r6("enc_absent").alias("enc_absent"),
                     "num_c_acctbal", "num_absent", r6("ix_c_acctbal_prob_coming").alias("ix_c_acctbal_prob_coming"))


DM_SQL = GAPS_SQL.split("dm AS (", 1)[1]
K_SQL = f"""{UN_SQL}, dm AS ({DM_SQL},
pv AS (SELECT jk, min(derivat_clean) AS dc, count(*) AS n FROM dm GROUP BY 1),
mv AS (SELECT dc, avg(n)/2.5 AS mean_visits FROM pv WHERE dc<>'UNKNOWN' GROUP BY 1),
kk AS (SELECT wl.*, ceil(coalesce(mean_visits,(SELECT avg(n)/2.5 FROM pv)))::BIGINT AS k FROM wl LEFT JOIN mv ON wl.derivat_clean=mv.dc)"""


def with_k(st):
    per = materialize(A.visits_per_entity(st.joined, "derivat_clean", "jk"))
    means = A.mean_visits_per_category(per, "derivat_clean").where(F.col("derivat_clean") != "UNKNOWN")
    means = means.withColumn("mean_visits", F.col("mean_visits") / 2.5)
    g = per.agg(F.avg("total") / 2.5).scalar()
    return FC.k_per_entity(will_come(st), "derivat_clean", means, g)


@query("k_per_entity", f"WITH {K_SQL} SELECT ent_id, derivat_clean, k FROM kk")
def _(spark, sf):
    st = Stages(spark, sf)
    return with_k(st).select("ent_id", "derivat_clean", "k")


def _pen(col, sets, cls, overlap):
    case = " ".join(f"WHEN {col}='{k}' THEN {'' if overlap else 'NOT '}list_has_any(string_split({cls},', '), {sorted(v)})" for k, v in sets.items())
    return f"coalesce(CASE {case} END, FALSE)"


PR_SQL = f"""{K_SQL}, {R.PROBS_SQL},
pr AS (SELECT kk.*, cls, code, p, p*CASE WHEN {_pen('bo', TYPICAL, 'cls', False)} THEN 0.8::DOUBLE ELSE 1 END AS adj_bo,
  p*CASE WHEN {_pen('prio', FORBIDDEN, 'cls', True)} THEN 0.3::DOUBLE ELSE 1 END AS adj_prio,
  p*CASE WHEN {_pen('bo', TYPICAL, 'cls', False)} THEN 0.8::DOUBLE ELSE 1 END*CASE WHEN {_pen('prio', FORBIDDEN, 'cls', True)} THEN 0.3::DOUBLE ELSE 1 END AS adj
  FROM kk JOIN cp ON kk.ent_id=cp.ent_id)"""


def ranked(st):
    return st.once("ranked", lambda: _ranked(st))


def _ranked(st):
    # a row per entity and class: the size of the keys' file, by which Spark would broadcast them, says too little
    df = with_k(st).join(R.class_probs(st.spark, st.sf).hint("merge"), "ent_id")
    p = F.col("p")
    bo = FC.affinity_penalty(p, "cls", FC.component_sets(TYPICAL, F.col("bo")))
    df = df.withColumns({"adj_bo": bo, "adj_prio": FC.mismatch_penalty(
        p, "cls", FC.component_sets(FORBIDDEN, F.col("prio")))})
    return df.withColumn("adj", FC.mismatch_penalty(F.col("adj_bo"), "cls", FC.component_sets(FORBIDDEN, F.col("prio"))))


@query("affinity_penalty", f"WITH {PR_SQL} SELECT ent_id, cls, round(adj_bo,6) AS adj_bo FROM pr")
def _(spark, sf):
    st = Stages(spark, sf)
    return ranked(st).select("ent_id", "cls", r6("adj_bo").alias("adj_bo"))


@query("mismatch_penalty", f"WITH {PR_SQL} SELECT ent_id, cls, round(adj_prio,6) AS adj_prio FROM pr")
def _(spark, sf):
    st = Stages(spark, sf)
    return ranked(st).select("ent_id", "cls", r6("adj_prio").alias("adj_prio"))


TK_SQL = f"""{PR_SQL}, tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ent_id ORDER BY adj DESC, code DESC) AS visit_number FROM pr) WHERE visit_number<=k),
mp AS (SELECT * FROM tk WHERE p>=0.02)"""


def top_visits(st):
    return FC.top_k_classes(ranked(st), "ent_id", "k", "adj")


def visits_kept(st):
    return st.once("kept", lambda: FC.min_probability(top_visits(st)))


@query("top_k_classes", f"WITH {TK_SQL} SELECT ent_id, cls, visit_number, round(p,6) AS p FROM tk")
def _(spark, sf):
    st = Stages(spark, sf)
    return top_visits(st).select("ent_id", "cls", "visit_number", r6("p").alias("p"))


@query("min_probability_filter", f"WITH {TK_SQL} SELECT ent_id, cls, visit_number FROM mp")
def _(spark, sf):
    st = Stages(spark, sf)
    return visits_kept(st).select("ent_id", "cls", "visit_number")


@query("max_visit_transform", f"WITH {TK_SQL} SELECT ent_id, cls, max(visit_number) OVER (PARTITION BY jk) AS max_visit FROM mp")
def _(spark, sf):
    st = Stages(spark, sf)
    return FC.max_visit(visits_kept(st), "jk").select("ent_id", "cls", "max_visit")


EXP_CTES = """pt AS (SELECT trim(unnest(string_split(cls,','))) AS type, k*p AS e FROM pr),
ex AS (SELECT type, sum(e) AS expected FROM pt GROUP BY 1),
ac AS (SELECT type, count(*) AS count_actual FROM (SELECT trim(unnest(string_split(umr_art,','))) AS type FROM cl) GROUP BY 1),
pd AS (SELECT type, count(*) AS count_predicted FROM (SELECT trim(unnest(string_split(cls,','))) AS type FROM mp) GROUP BY 1),
pe AS (SELECT coalesce(ac.type,pd.type) AS type, coalesce(count_actual,0) AS count_actual, coalesce(count_predicted,0) AS count_predicted
  FROM ac FULL JOIN pd ON ac.type=pd.type),
cc AS (SELECT pe.*, coalesce(round_even(expected,0),0)::BIGINT AS count_expected FROM pe LEFT JOIN ex ON pe.type=ex.type)"""
EXP_SQL = f"{TK_SQL}, {EXP_CTES}"
FACT_SQL = f"{EXP_CTES}, fa AS (SELECT type, coalesce(round_even(count_actual::DOUBLE/nullif(count_predicted,0),3),1.0) AS factor FROM cc)"


def factors(st):
    """Actual over predicted visits per type, from the backtest counts."""
    return st.once("factors", lambda: FC.calibration_factors(counts(st)))


@query("calibration_weight", f"WITH {TK_SQL}, {FACT_SQL} SELECT ent_id, cls, coalesce(factor,1.0) AS calibration_weight FROM mp LEFT JOIN fa ON cls=type")
def _(spark, sf):
    st = Stages(spark, sf)
    return FC.calibration_weight(visits_kept(st), factors(st), "cls").select("ent_id", "cls", "calibration_weight")


# -- durations and dates ----------------------------------------------------------

DU_SQL = f"""{TK_SQL}, {FACT_SQL},
tg AS (SELECT {TYPE_GROUP_SQL} AS type_group, quantile_cont({DUR},0.5)::DOUBLE AS type_median FROM cl WHERE {DUR}>=0 AND {TYPE_GROUP_SQL} IS NOT NULL GROUP BY 1),
om AS (SELECT quantile_cont({DUR},0.5)::DOUBLE AS m FROM cl WHERE {DUR}>=0),
fcv AS (SELECT date_trunc('month',umr_start)::TIMESTAMP AS month, sum(floor(cost))/count(*)/1000 AS value FROM cl GROUP BY 1),
nm AS (SELECT ent_id, value FROM (SELECT ent_id, value, row_number() OVER (PARTITION BY ent_id ORDER BY
    abs(date_diff('month', month, date_trunc('month',rueckgabe_soll))), month DESC) AS rn FROM kk, fcv WHERE rueckgabe_soll IS NOT NULL) WHERE rn=1),
du AS (SELECT mp.*, {R.MD5.format("mp.ent_id||cls||'d'")}%400/10.0::DOUBLE AS dur_model, type_median, coalesce(nm.value,(SELECT avg(value) FROM fcv)) AS dur_ts
  FROM mp LEFT JOIN (SELECT DISTINCT umr_art, {TYPE_GROUP_SQL} AS type_group FROM cl) t ON cls=umr_art LEFT JOIN tg ON t.type_group=tg.type_group LEFT JOIN nm ON mp.ent_id=nm.ent_id)"""


def modelled(st):
    """Kept visits with the model's duration."""
    return visits_kept(st).withColumn("dur_model", md5_int(F.concat("ent_id", "cls", F.lit("d"))) % 400 / F.lit(10.0))


def with_durations(st):
    v = st.cleaned
    d = v.withColumn("d", floor_days("umr_av", "umr_start").cast("double")).where(F.col("d") >= 0)
    mapping = type_mapping(v)
    med = discrete_quantiles(A.with_type_group(d, mapping).where(F.col("type_group").isNotNull()), ["type_group"],
                             "d", {"type_median": 0.5})
    overall = discrete_quantiles(d, [], "d", {"m": 0.5}).scalar()
    df = A.with_type_group(modelled(st), mapping, "cls")
    df = FE.lookup(df, med, "type_group", "type_group", "type_median", "type_median", F.lit(None).cast("double"))
    fc = (v.groupBy(F.date_trunc("month", "umr_start").alias("month")).agg((F.sum(F.floor("cost")) / F.count(F.lit(1)) / 1000).alias("value")))
    return J.nearest_month_value(df, "rueckgabe_soll", fc, out="dur_ts"), overall


@query("duration_blend", f"""WITH {DU_SQL} SELECT ent_id, cls, round(0.3::DOUBLE*dur_model+0.7::DOUBLE*coalesce(type_median,(SELECT m FROM om)),6) AS dual,
  round(0.21::DOUBLE*dur_model+0.49::DOUBLE*coalesce(type_median,(SELECT m FROM om))+0.3::DOUBLE*dur_ts,6) AS triple FROM du""")
def _(spark, sf):
    st = Stages(spark, sf)
    df, overall = with_durations(st)
    return df.select("ent_id", "cls", r6(FC.duration_blend("dur_model", "type_median", overall)).alias("dual"),
                     r6(FC.duration_blend("dur_model", "type_median", overall, "dur_ts")).alias("triple"))


@query("anchor_date", f"""WITH {UN_SQL} SELECT ent_id, strftime(coalesce(rueckgabe_soll, CASE WHEN ent_id%2=0 THEN sop END, TIMESTAMP '{R.AS_OF}'),'%Y-%m-%d') AS anchor,
  CASE WHEN rueckgabe_soll IS NOT NULL THEN 'rueckgabe_soll' WHEN ent_id%2=0 THEN 'anlauf_sop' ELSE 'now' END AS anchor_source FROM un""")
def _(spark, sf):
    st = Stages(spark, sf)
    df = unseen(st).withColumn("sop", F.when(F.col("ent_id") % 2 == 0, F.col("sop")))
    return FC.anchor_date(df, R.AS_OF).select("ent_id", day("anchor").alias("anchor"), "anchor_source")


DATED_SQL = f"""{DU_SQL},
gm AS (SELECT derivat_clean AS dc, quantile_cont(gap,0.5)::DOUBLE AS g FROM gp WHERE gap BETWEEN 1 AND 999 AND derivat_clean<>'MACHINERY' GROUP BY 1),
gg AS (SELECT quantile_cont(gap,0.5)::DOUBLE AS g FROM gp WHERE gap>0 AND gap<1000),
da AS (SELECT *, coalesce(rueckgabe_soll, sop, TIMESTAMP '{R.AS_OF}') - to_microseconds(round((dur_model+(max(visit_number) OVER (PARTITION BY jk)-visit_number)
   *coalesce(gm.g,(SELECT g FROM gg)))*86400000000.0::DOUBLE)::BIGINT) AS estimated_start FROM du LEFT JOIN gm ON du.derivat_clean=gm.dc),
ho AS (SELECT *, date_trunc('month',estimated_start)::TIMESTAMP AS estimated_month FROM da WHERE date_trunc('month',estimated_start)>=TIMESTAMP '2001-08-01'
  AND date_trunc('month',estimated_start)<=TIMESTAMP '2003-08-01')"""


def dated(st):
    df = FC.anchor_date(modelled(st).withColumn("predicted_duration_days", F.col("dur_model")), R.AS_OF)
    every = materialize(A.visit_gaps(st.joined, "jk", extra=["derivat_clean"]))
    gaps = A.inter_visit_gap_by_category(None, "derivat_clean", gaps=every).where(F.col("derivat_clean") != "MACHINERY")
    g = A.inter_visit_gap(None, gaps=every).select("median_days").scalar()
    return FC.backward_stagger(df, "jk", gaps, "derivat_clean", g)


@query("backward_stagger", f"WITH {DATED_SQL} SELECT ent_id, cls, visit_number, strftime(estimated_start,'%Y-%m-%d %H:%M:%S') AS estimated_start FROM da")
def _(spark, sf):
    st = Stages(spark, sf)
    return dated(st).select("ent_id", "cls", "visit_number", day("estimated_start", "yyyy-MM-dd HH:mm:ss").alias("estimated_start"))


def in_horizon(st):
    return FC.horizon_filter(dated(st), R.AS_OF)


@query("horizon_filter", f"WITH {DATED_SQL} SELECT ent_id, cls, {sql_month('estimated_month')} AS estimated_month FROM ho")
def _(spark, sf):
    st = Stages(spark, sf)
    return in_horizon(st).select("ent_id", "cls", day("estimated_month", "yyyy-MM").alias("estimated_month"))


CAL_SQL = f"""{DATED_SQL},
hr AS (SELECT *, ent_id*10+code AS row_id, coalesce(factor, 1.0) AS cw, row_number() OVER (PARTITION BY cls ORDER BY round(p,3) DESC, ent_id*10+code) AS rn,
  count(*) OVER (PARTITION BY cls) AS n FROM ho LEFT JOIN fa ON cls=type),
ht AS (SELECT *, greatest(1, round_even(n*factor,0)) AS tn FROM hr),
rc AS (SELECT *, 0 AS copy FROM ht WHERE factor IS NULL OR factor BETWEEN 0.5 AND 1.5 OR tn>=n OR rn<=tn
  UNION ALL SELECT *, 1 FROM ht WHERE factor>1.5 AND tn>n AND rn<=least(tn-n, n))"""


def calibrated(st):
    df = in_horizon(st).withColumns({"row_id": F.col("ent_id") * 10 + F.col("code"), "pr": F.round("p", 3)})
    df = FC.calibration_weight(df, factors(st), "cls")
    return FC.row_calibration(df, factors(st), "cls", "pr")


@query("row_calibration", f"WITH {CAL_SQL} SELECT ent_id, cls, visit_number, copy::BIGINT AS copy FROM rc")
def _(spark, sf):
    st = Stages(spark, sf)
    return calibrated(st).select("ent_id", "cls", "visit_number", "copy")


@query("nlargest_trim_duplicate", f"WITH {CAL_SQL} SELECT cls, count(*) AS n, sum(copy)::BIGINT AS duplicates FROM rc GROUP BY 1")
def _(spark, sf):
    st = Stages(spark, sf)
    return calibrated(st).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("copy").alias("duplicates"))


@query("forecast_counts", f"""WITH {CAL_SQL} SELECT {sql_month('estimated_month')} AS month, cls AS type, count(*) AS n, round_even(round(sum(cw),6),0)::BIGINT AS n_calibrated FROM rc GROUP BY 1,2""")
def _(spark, sf):
    st = Stages(spark, sf)
    df = calibrated(st).withColumn("calibration_weight", F.col("calibration_weight").cast("decimal(18,6)"))
    df = FC.forecast_counts(df, R.AS_OF, type_col="cls")
    return df.select(day("estimated_month", "yyyy-MM").alias("month"), F.col("cls").alias("type"), "n", "n_calibrated")


@query("forecast_pivot", f"""WITH {CAL_SQL} SELECT {sql_month('estimated_month')} AS month, {", ".join(
    f"count(*) FILTER (cls='{p}') AS \"{p}\"" for p in R.PACKAGES)}, count(*) AS total FROM rc GROUP BY 1""")
def _(spark, sf):
    st = Stages(spark, sf)
    df = FC.forecast_pivot(calibrated(st), R.AS_OF, R.PACKAGES, type_col="cls")
    return df.withColumn("month", day("estimated_month", "yyyy-MM")).drop("estimated_month")


@query("duration_by_group", f"""WITH {DU_SQL} SELECT cls, count(*) AS count, round(avg(dur_model),6) AS mean, round(stddev_samp(dur_model),6) AS std,
  min(dur_model) AS min, max(dur_model) AS max, round(quantile_cont(dur_model,0.5),6) AS median FROM du GROUP BY 1""")
def _(spark, sf):
    st = Stages(spark, sf)
    df = FC.duration_by_group(st.once("modelled", lambda: modelled(st).select("cls", "dur_model")), "cls", "dur_model")
    return df.select("cls", "count", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max", r6("median").alias("median"))


@query("dashboard_tables", f"""WITH {DU_SQL} SELECT cls, count(*) AS n, round(count(*)*100.0/(SELECT count(*) FROM du),6) AS share_pct,
  round(quantile_cont(dur_model,0.25),6) AS q25, round(quantile_cont(dur_model,0.5),6) AS q50, round(quantile_cont(dur_model,0.75),6) AS q75 FROM du GROUP BY 1""")
def _(spark, sf):
    st = Stages(spark, sf)
    df = FC.dashboard_totals(st.once("modelled", lambda: modelled(st).select("cls", "dur_model")), "cls", "dur_model")
    return df.select("cls", "n", *[r6(c).alias(c) for c in ("share_pct", "q25", "q50", "q75")])


@query("probability_histogram", f"WITH {UN_SQL} SELECT least(floor(prob_coming/0.05)::BIGINT+1,20) AS bin, count(*) AS n FROM un GROUP BY 1")
def _(spark, sf):
    st = Stages(spark, sf)
    return A.histogram(unseen(st), "prob_coming", 20, 0.0, 1.0)


def _blend_sql(triple):
    ws = "1-wm-wt" if triple else "0"
    wt = "wt" if triple else "1-wm"
    src = ("(SELECT a/10.0 AS wm, b/10.0 AS wt, a*100+b AS i FROM (SELECT unnest(range(11)) AS a), (SELECT unnest(range(11)) AS b) WHERE a+b<=10)"
           if triple else "(SELECT a/10.0 AS wm, 0 AS wt, a AS i FROM (SELECT unnest(range(11)) AS a))")
    return f"""g AS (SELECT wm::DOUBLE AS wm, round(({wt}),4)::DOUBLE AS wt, round(({ws}),4)::DOUBLE AS ws, i FROM {src}),
m AS (SELECT i, any_value(wm) AS wm, any_value(g.wt) AS wt, any_value(g.ws) AS ws, count(*) AS n, avg(abs(y-(wm*yhat+g.wt*yhat2+g.ws*tsv))) AS mae FROM dd, g GROUP BY 1)
SELECT n, wm AS w_model, wt AS w_type, ws AS w_ts, round(mae,6) AS mae FROM m ORDER BY round(mae,9), i LIMIT 1"""


@query("blend_grid_search", f"WITH {R.DURATIONS_SQL}, dd AS (SELECT *, round(y*0.5+8,2) AS tsv FROM du WHERE split='test'), {_blend_sql(True)}")
def _(spark, sf):
    d = R.durations(spark, sf).where("split = 'test'").withColumn("tsv", F.round(F.col("y") * 0.5 + 8, 2))
    df = FC.blend_grid_search(d, "y", "yhat", "yhat2", "tsv")
    return df.withColumn("mae", r6("mae"))


@query("blend_grid_search_dual", f"WITH {R.DURATIONS_SQL}, dd AS (SELECT *, 0.0 AS tsv FROM du WHERE split='test'), {_blend_sql(False)}")
def _(spark, sf):
    df = FC.blend_grid_search(R.durations(spark, sf).where("split = 'test'"), "y", "yhat", "yhat2")
    return df.withColumn("mae", r6("mae"))


# -- backtest and export ------------------------------------------------------------

@query("expected_counts", f"WITH {EXP_SQL} SELECT type, round(expected,4) AS expected FROM ex")
def _(spark, sf):
    st = Stages(spark, sf)
    df = FC.expected_counts(ranked(st))
    return df.select("type", F.round("expected", 4).alias("expected"))


def counts(st):
    return FC.backtest_counts(FC.type_counts(st.cleaned, "umr_art", "count_actual"),
                              FC.type_counts(visits_kept(st), "cls", "count_predicted"),
                              FC.expected_counts(ranked(st)))


_PCT = "round_even(({0}-count_actual)*100.0::DOUBLE/{1},1)"


def _bt(src, name, base):
    return f"""SELECT {name} AS type, count_actual, count_predicted, count_expected, count_predicted-count_actual AS diff,
  {_PCT.format('count_predicted', base)} AS pct_diff, count_expected-count_actual AS exp_diff, {_PCT.format('count_expected', base)} AS exp_pct_diff FROM {src}"""


@query("backtest_counts", f"""WITH {EXP_SQL}, tt AS (SELECT sum(count_actual)::BIGINT AS count_actual, sum(count_predicted)::BIGINT AS count_predicted, sum(count_expected)::BIGINT AS count_expected FROM cc)
{_bt('cc', 'type', 'nullif(count_actual,0)')} UNION ALL {_bt('tt', "'TOTAL'", 'greatest(count_actual,1)')}""")
def _(spark, sf):
    st = Stages(spark, sf)
    return counts(st)


@query("calibration_factors", f"WITH {EXP_SQL} SELECT type, coalesce(round_even(count_actual::DOUBLE/nullif(count_predicted,0),3),1.0) AS factor FROM cc")
def _(spark, sf):
    st = Stages(spark, sf)
    return FC.calibration_factors(counts(st))


@query("monthly_backtest", f"""WITH {TK_SQL}, {FACT_SQL}, fm AS (SELECT jk, {sql_month('arg_min(umr_start, visit_id)')} AS month FROM cl GROUP BY 1),
atm AS (SELECT type, month, count(*) AS actual FROM (SELECT trim(unnest(string_split(umr_art,','))) AS type, {sql_month('umr_start')} AS month FROM cl) GROUP BY 1,2),
pp AS (SELECT type, month, count(*) AS predicted FROM (SELECT trim(unnest(string_split(cls,','))) AS type, month FROM mp JOIN fm ON mp.jk=fm.jk) GROUP BY 1,2),
mm AS (SELECT coalesce(atm.type,pp.type) AS type, coalesce(atm.month,pp.month) AS month, coalesce(actual,0) AS actual, coalesce(predicted,0) AS predicted
  FROM atm FULL JOIN pp ON atm.type=pp.type AND atm.month=pp.month),
ke AS (SELECT type FROM atm GROUP BY 1 HAVING sum(actual)>=50)
SELECT mm.*, round(predicted*coalesce(factor,1.0),6) AS calibrated FROM mm LEFT JOIN fa ON mm.type=fa.type WHERE mm.type IN (SELECT type FROM ke)""")
def _(spark, sf):
    st = Stages(spark, sf)
    fm = J.first_visit_month(st.cleaned, "jk", order="visit_id").select("jk", day("month", "yyyy-MM").alias("month"))
    act = FC.explode_types(st.cleaned, "umr_art").select("type", day("umr_start", "yyyy-MM").alias("month"))
    prd = FC.explode_types(visits_kept(st), "cls").join(fm, "jk").select("type", "month")
    df = FC.monthly_backtest(act, prd, factors(st))
    return df.withColumn("calibrated", r6("calibrated"))


@query("export_table", f"""WITH {CAL_SQL}
SELECT v_nummer, strftime(umr_start,'%Y-%m-%d %H:%M:%S') AS umr_start, strftime(umr_av,'%Y-%m-%d %H:%M:%S') AS umr_av, umr_status, umr_art,
  NULL::DOUBLE AS prob_coming, NULL::DOUBLE AS type_probability, NULL AS visit_number, NULL AS forecast_binary_model, NULL::DOUBLE AS forecast_threshold, NULL AS forecast_timestamp FROM vis
UNION ALL SELECT v_nummer, strftime(estimated_start,'%Y-%m-%d %H:%M:%S'), strftime(estimated_start+to_microseconds(round(dur_model*86400000000.0::DOUBLE)::BIGINT),'%Y-%m-%d %H:%M:%S'), 'Forecast', cls,
  round_even(prob_coming,4), round_even(p,4), visit_number, 'lr', 0.05::DOUBLE, '{R.AS_OF}' FROM rc""")
def _(spark, sf):
    st = Stages(spark, sf)
    st.visits  # written before the cleaned visits, which then read it too
    fc = calibrated(st).withColumns({"predicted_type": F.col("cls"), "type_probability": F.col("p")})
    base = ["v_nummer", "umr_start", "umr_av", "umr_status", "umr_art"]
    df = FC.export_table(st.visits, fc, base, {"binary_model": "lr", "threshold": 0.05, "as_of": R.AS_OF}, direct=["v_nummer"])
    fmt = "yyyy-MM-dd HH:mm:ss"
    return df.select("v_nummer", day("umr_start", fmt).alias("umr_start"), day("umr_av", fmt).alias("umr_av"), "umr_status", "umr_art",
                     "prob_coming", "type_probability", "visit_number", "forecast_binary_model", "forecast_threshold", "forecast_timestamp")


# -- the trained forecast -----------------------------------------------------------

SPEC = BU.Spec("ent_id", "jk", ("derivat_clean", "bo_clean", "motortyp_clean", "basistyp_clean", "hybrid_clean"), ("c_acctbal", "age_months"),
               binary_kinds=("logreg", "rf"), duration_kinds=("ridge", "rf"))


def trained(st):
    """(bundle, entities, visits); fitted once per data and session folder."""
    ent = K.clean_categoricals(st.labelled, ["derivat", "bo", "motortyp", "basistyp", "hybrid"])
    ent = ent.withColumn("age_months", F.months_between(F.lit(R.AS_OF).cast("timestamp"), "sop"))
    ent, vis = st.once("bundle_entities", lambda: ent), st.cleaned
    store = ResultStore(st.spark, f"{checkpoint_dir(st.spark)}/bundles", ent, vis)
    return BU.fit_bundle(store, ent, vis, SPEC), ent, vis


@query("trained_champions", """SELECT unnest(['binary','duration','multiclass']) AS task, unnest([2,2,2])::BIGINT AS candidates, 1::BIGINT AS chosen, 1 AS scored""")
def _(spark, sf):
    b, _, _ = trained(Stages(spark, sf))
    return b.champions.groupBy("task").agg(F.count(F.lit(1)).alias("candidates"), F.sum("chosen").alias("chosen"),
                                           F.min(F.col("score").isNotNull().cast("int")).alias("scored"))


@query("trained_backtest", f"""WITH {BOTH_SQL}, ln AS (SELECT trim(unnest(string_split(umr_art,','))) AS type FROM cl WHERE jk IN (SELECT jk FROM ek)),
c AS (SELECT type, count(*) AS n FROM ln GROUP BY 1)
SELECT type, n AS count_actual, 1 AS adds_up FROM c UNION ALL SELECT 'TOTAL', sum(n)::BIGINT, 1 FROM c""")
def _(spark, sf):
    """Actual counts, and whether predictions, expectations and differences add up to the TOTAL row."""
    b, ent, vis = trained(Stages(spark, sf))
    t = materialize(BU.run_backtest(b, ent, vis))
    total = t.where("type = 'TOTAL'").select(F.struct("count_predicted", "count_expected").alias("t")).scalar()
    sums = t.where("type <> 'TOTAL'").agg(F.struct(F.sum("count_predicted").alias("p"), F.sum("count_expected").alias("e")).alias("s")).scalar()
    own = (F.col("diff") == F.col("count_predicted") - F.col("count_actual")) & (F.col("exp_diff") == F.col("count_expected") - F.col("count_actual"))
    same = (total["count_predicted"] == sums["p"]) & (total["count_expected"] == sums["e"]) & (sums["p"] > 0)
    return t.select("type", "count_actual", (own & same).cast("int").alias("adds_up"))


def trained_rows(st):
    b, ent, vis = trained(st)
    factors = FC.calibration_factors(BU.run_backtest(b, ent, vis))
    return b, materialize(BU.run_forecast(b, ent, R.AS_OF, factors=factors))


@query("trained_forecast", f"""WITH {UN_SQL} SELECT 1 AS some_rows, 1 AS all_unseen, 1 AS one_row_per_visit, 1 AS visits_from_one, 1 AS in_horizon, 1 AS counts_reconcile,
  1 AS probabilities FROM (SELECT count(*) AS n FROM un) WHERE n>0""")
def _(spark, sf):
    """What holds for every trained forecast: only unseen entities, each visit once (and once more if
    duplicated), visits numbered 1 to K, months inside of the horizon, month x type counts that add up."""
    st = Stages(spark, sf)
    b, rows = trained_rows(st)
    un = unseen(st).select(F.col("ent_id").alias("u"))
    known = rows.join(un, F.col("ent_id") == F.col("u"), "left").agg(F.count_if(F.col("u").isNull()).alias("n")).select("n").scalar()
    per = rows.groupBy("ent_id", "visit_number", "copy").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    counted = FC.forecast_counts(rows, R.AS_OF, type_col="cls").agg(F.sum("n")).scalar()
    now = F.date_trunc("month", F.lit(R.AS_OF).cast("timestamp"))
    month, p = F.col("estimated_month"), F.col("type_probability")
    return rows.agg(
        (F.count(F.lit(1)) > 0).cast("int").alias("some_rows"), (known == 0).cast("int").alias("all_unseen"), (per == 1).cast("int").alias("one_row_per_visit"),
        F.min(F.col("visit_number").between(1, F.col("k")).cast("int")).alias("visits_from_one"),
        F.min(month.between(now, F.add_months(now, C.HORIZON_MONTHS)).cast("int")).alias("in_horizon"),
        (counted == F.count(F.lit(1))).cast("int").alias("counts_reconcile"),
        F.min(((F.col("prob_coming") >= C.FORECAST_THRESHOLD) & (p >= C.MIN_TYPE_PROBABILITY) & (p <= 1)).cast("int")).alias("probabilities"))


@query("trained_export", f"""WITH {R.VISITS_SQL} SELECT umr_status, count(*) AS n, 0::BIGINT AS scored FROM vis GROUP BY 1 UNION ALL SELECT 'Forecast', NULL, NULL""")
def _(spark, sf):
    """The whole export per status: history rows are counted; forecast rows hold the champions' names."""
    st = Stages(spark, sf)
    st.visits  # as in export_table
    b, rows = trained_rows(st)
    base = ["v_nummer", "umr_start", "umr_av", "umr_status", "umr_art"]
    df = BU.export(b, st.visits, rows, base, R.AS_OF, direct=["v_nummer"])
    forecast = F.col("umr_status") == C.FORECAST
    named = F.col("forecast_binary_model").isin(*SPEC.binary_kinds) & F.col("forecast_duration_model").isin(*SPEC.duration_kinds)
    out = df.groupBy("umr_status").agg(F.count(F.lit(1)).alias("n"), F.count("prob_coming").alias("scored"), F.min(F.coalesce(named, F.lit(False))).alias("ok"))
    return out.select("umr_status", F.when(forecast & F.col("ok") & (F.col("n") == F.col("scored")), F.lit(None)).otherwise(F.col("n")).alias("n"),
                      F.when(forecast & F.col("ok"), F.lit(None)).otherwise(F.col("scored")).alias("scored"))
