"""Monthly series and forecaster queries."""

from pyspark.sql import functions as F

from visitgrid.catalog.cleansing import cleaned, day
from visitgrid.catalog.registry import query
from visitgrid.catalog.tables import sql_month
from visitgrid.functions.core import r6
from visitgrid.operators import lags as LG
from visitgrid.operators import series as TS
from visitgrid.plans import roles as R

BY = ["series_id"]
ARR_SQL = f"""{R.MONTHLY_SQL}, ar AS (SELECT series_id, list(y ORDER BY month) AS ys, list(n::DOUBLE ORDER BY month) AS ns,
  max(month) AS last_month FROM mo GROUP BY 1)"""


def arrays(spark, sf):
    return TS.to_arrays(R.monthly(spark, sf), BY)


def _ones(h):
    return "[" + ",".join(["[0.0::DOUBLE]"] * h) + "]"


def sql_sma(ys, h, w):
    return f"list_reduce({_ones(h)}, lambda a, e: list_append(a, list_avg(a[-{w}:])), {ys})[len({ys})+1:]"


def sql_flat(v, h):
    return f"list_transform(range({h}), lambda i: {v})"


def sql_ses(ys, h):
    return sql_flat(f"list_reduce({ys}, lambda s, x: 0.3::DOUBLE*x+(1-0.3::DOUBLE)*s)", h)


def sql_croston_value(ys):
    e = f"list_transform({ys}[2:], lambda v: {{'q':0.0::DOUBLE,'a':0.0::DOUBLE,'s':0.0::DOUBLE,'v':v}})"
    init = f"{{'q':coalesce(list_filter({ys}, lambda v: v>0)[1],0.0::DOUBLE),'a':1.0::DOUBLE,'s':0.0::DOUBLE,'v':0.0::DOUBLE}}"
    step = ("lambda p, x: CASE WHEN x.v>0 THEN {'q':0.1::DOUBLE*x.v+0.9::DOUBLE*p.q,'a':0.1::DOUBLE*(p.s+1)+0.9::DOUBLE*p.a,"
            "'s':0.0::DOUBLE,'v':0.0::DOUBLE} ELSE {'q':p.q,'a':p.a,'s':p.s+1,'v':0.0::DOUBLE} END")
    return f"list_transform([list_reduce({e}, {step}, {init})], lambda z: greatest(z.q/z.a,0))[1]"


def sql_croston(ys, h):
    return f"list_transform(list_resize([{sql_croston_value(ys)}], {h}, {sql_croston_value(ys)}), lambda v: v)"


def sql_hw(ys, h):
    grid = "[" + ",".join(f"{{'i':{i},'a':{a}::DOUBLE,'b':{b}::DOUBLE,'g':{g}::DOUBLE}}" for i, (a, b, g) in enumerate(TS.HW_GRID)) + "]"
    m1, m2 = f"list_avg({ys}[1:12])", f"list_avg({ys}[13:24])"
    e = f"list_transform({ys}[13:], lambda v: {{'l':0.0::DOUBLE,'t':0.0::DOUBLE,'s':[0.0::DOUBLE],'e':0.0::DOUBLE,'v':v}})"
    init = f"{{'l':{m1},'t':({m2}-{m1})/12,'s':list_transform({ys}[1:12], lambda v: v-{m1}),'e':0.0::DOUBLE,'v':0.0::DOUBLE}}"
    l2 = "(k.a*(x.v-p.s[1])+(1-k.a)*(p.l+p.t))"
    step = (f"lambda p, x: {{'l':{l2},'t':k.b*({l2}-p.l)+(1-k.b)*p.t,'s':list_append(p.s[2:12], k.g*(x.v-{l2})+(1-k.g)*p.s[1]),"
            f"'e':p.e+(x.v-(p.l+p.t+p.s[1]))*(x.v-(p.l+p.t+p.s[1])),'v':0.0::DOUBLE}}")
    fits = f"list_transform({grid}, lambda k: {{'i':k.i,'z':list_reduce({e}, {step}, {init})}})"
    best = f"list_sort(list_transform({fits}, lambda f: {{'e':f.z.e,'i':f.i,'z':f.z}}))[1].z"
    return f"list_transform([{best}], lambda z: list_transform(range(1,{h}+1), lambda j: greatest(z.l+j*z.t+z.s[(j-1)%12+1],0)))[1]"


def fc_sql(src, ys, h):
    """One row per (series, model) with the forecast list."""
    models = {"SMA(3)": sql_sma(ys, h, 3), "SMA(6)": sql_sma(ys, h, 6), "SES": sql_ses(ys, h),
              "ETS(add)": sql_hw(ys, h), "Croston": sql_croston(ys, h),
              "SBA": f"list_transform({sql_croston(ys, h)}, lambda v: v*0.95::DOUBLE)"}
    return " UNION ALL ".join(f"SELECT series_id, '{m}' AS model, {e} AS fc FROM {src}" for m, e in models.items())


def _points(df, col, h):
    """(series_id, i, value) rows of a forecast array."""
    out = df.select("series_id", F.posexplode(col).alias("i", "value"))
    return out.select("series_id", F.col("i").cast("long").alias("i"), F.round("value", 3).alias("value"))


#: Months ahead.
H = 18


def _fc_query(expr, src="ar"):
    return f"""WITH {ARR_SQL}, f AS (SELECT series_id, {expr} AS fc FROM {src})
SELECT series_id, unnest(range(len(fc))) AS i, round(unnest(fc),3) AS value FROM f"""


@query("forecast_sma", _fc_query(sql_sma("ys", H, 3)))
def _(spark, sf):
    return _points(arrays(spark, sf), TS.sma("ys", H, 3), H)


@query("forecast_sma6", _fc_query(sql_sma("ys", H, 6)))
def _(spark, sf):
    return _points(arrays(spark, sf), TS.sma("ys", H, 6), H)


@query("forecast_ses", _fc_query(sql_ses("ys", H)))
def _(spark, sf):
    return _points(arrays(spark, sf), TS.ses("ys", H), H)


# sparse series: counts kept only in months whose count is above a threshold
SPARSE = "list_transform(ys, lambda v: CASE WHEN v>155000 THEN v ELSE 0.0::DOUBLE END)"
SPARSE_SQL = f"(SELECT series_id, {SPARSE} AS zs FROM ar)"


def sparse(spark, sf):
    return arrays(spark, sf).withColumn("zs", F.transform("ys", lambda v: F.when(v > 155000, v).otherwise(F.lit(0.0))))


@query("forecast_croston", _fc_query(sql_croston("zs", H), SPARSE_SQL))
def _(spark, sf):
    return _points(sparse(spark, sf), TS.croston("zs", H), H)


@query("forecast_sba", _fc_query(f"list_transform({sql_croston('zs', H)}, lambda v: v*0.95::DOUBLE)", SPARSE_SQL))
def _(spark, sf):
    return _points(sparse(spark, sf), TS.sba("zs", H), H)


@query("forecast_holt_winters", _fc_query(sql_hw("ys", H)))
def _(spark, sf):
    return _points(TS.holt_winters(arrays(spark, sf), BY, "ys", H), F.col("fc"), H)


BENCH_SQL = f"""{ARR_SQL}, sp AS (SELECT series_id, last_month, ys AS full_ys, ys[1:greatest(floor(len(ys)*0.8),6)::BIGINT] AS ys,
  ys[greatest(floor(len(ys)*0.8),6)::BIGINT+1:] AS test FROM ar WHERE len(ys)>=12),
ff AS ({fc_sql('sp', 'ys', 20)}),
pp AS (SELECT ff.series_id, model, unnest(test) AS y, unnest(fc[1:len(test)]) AS p FROM ff JOIN sp ON ff.series_id=sp.series_id),
bm AS (SELECT series_id, model, count(*) AS n, avg(abs(y-p)) AS mae, sqrt(avg((y-p)**2)) AS rmse, 1-sum((y-p)**2)/(var_pop(y)*count(*)) AS r2 FROM pp GROUP BY 1,2),
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mae, model) AS rank FROM bm)"""


def bench(spark, sf):
    return TS.ts_benchmark(R.monthly(spark, sf), BY)


@query("ts_benchmark", f"WITH {BENCH_SQL} SELECT series_id, model, n, round(mae,3) AS mae, round(rmse,3) AS rmse, round(r2,4) AS r2, rank FROM rk")
def _(spark, sf):
    df = bench(spark, sf)
    return df.select("series_id", "model", "n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"),
                     F.round("r2", 4).alias("r2"), "rank")


@query("ts_forecast_best", f"""WITH {BENCH_SQL}, fu AS (SELECT series_id, last_month, full_ys AS ys FROM sp),
f2 AS ({fc_sql('fu', 'ys', H)}),
j AS (SELECT f2.series_id, f2.model, fc, last_month FROM f2 JOIN rk ON f2.series_id=rk.series_id AND f2.model=rk.model AND rank=1 JOIN fu ON fu.series_id=f2.series_id)
SELECT series_id, model, strftime(last_month + to_months((unnest(range(1,{H}+1)))::INTEGER), '%Y-%m') AS month, round(unnest(fc),3) AS value FROM j""")
def _(spark, sf):
    from visitgrid.plans.ordered import materialize
    m = R.monthly(spark, sf)
    df = TS.forecast_best(m, BY, materialize(bench(spark, sf)), h=H)
    return df.select("series_id", "model", day("month", "yyyy-MM").alias("month"), F.round("value", 3).alias("value"))


# Ridge (penalty 1) and plain least squares (penalty 0) per series and fold: normal equations of the
# scaled, centred lags, solved by elimination, one pivot per step of the recursion (g).
LAG_SQL = """
ls AS (SELECT series_id, ys, least(6, greatest(3, len(ys)//5)) AS nl FROM ar),
rw AS (SELECT series_id, nl, len(ys)-nl AS n, i-nl-1 AS i, list_reverse(ys[i-nl:i-1]) AS x, ys[i] AS y
  FROM (SELECT *, unnest(range(nl+1, len(ys)+1)) AS i FROM ls WHERE len(ys)>=nl+6)),
sh AS (SELECT series_id, nl, max(n) AS n, greatest(nl+2, max(n)//3) AS fi, greatest(1, max(n)//6) AS sz FROM rw GROUP BY 1,2),
fk AS (SELECT *, unnest(range(greatest(1, (n-fi)//sz))) AS k FROM sh),
fl AS (SELECT series_id, n, k, fi+k*sz AS a, fi+(k+1)*sz AS b FROM fk WHERE fi+(k+1)*sz<=n),
fo AS (SELECT * FROM fl UNION ALL SELECT series_id, n, max(k)+1, max(b), n FROM fl GROUP BY 1,2 HAVING max(b)<n
  UNION ALL SELECT series_id, n, 0, fi, n FROM sh WHERE series_id NOT IN (SELECT series_id FROM fl)),
lx AS (SELECT series_id, i, y, unnest(range(1, nl+1)) AS j, unnest(x) AS v FROM rw),
mm AS (SELECT lx.series_id, k, a, b, j, min(v) AS lo, max(v) AS hi FROM lx JOIN fo ON lx.series_id=fo.series_id AND i<a GROUP BY ALL),
sc AS (SELECT lx.series_id, k, a, b, i, lx.j, y, CASE WHEN hi=lo THEN v-lo ELSE (v-lo)/(hi-lo) END AS s FROM lx JOIN mm ON lx.series_id=mm.series_id AND lx.j=mm.j WHERE i<b),
me AS (SELECT series_id, k, j, avg(s) AS ms, avg(y) AS my FROM sc WHERE i<a GROUP BY ALL),
ce AS (SELECT sc.series_id, sc.k, a, b, i, sc.j, s-ms AS c, y-my AS t, y, my FROM sc JOIN me ON sc.series_id=me.series_id AND sc.k=me.k AND sc.j=me.j),
ax AS (SELECT p.series_id, p.k, p.j, q.j AS jj, sum(p.c*q.c) AS v FROM ce p JOIN ce q ON p.series_id=q.series_id AND p.k=q.k AND p.i=q.i WHERE p.i<p.a GROUP BY ALL),
bx AS (SELECT series_id, k, j, sum(c*t) AS v FROM ce WHERE i<a GROUP BY ALL),
ro AS (SELECT ax.series_id, ax.k, model, ax.j, list_append(list(ax.v+CASE WHEN ax.j=jj THEN alpha ELSE 0 END ORDER BY jj), any_value(bx.v)) AS r
  FROM ax JOIN bx ON ax.series_id=bx.series_id AND ax.k=bx.k AND ax.j=bx.j, (SELECT unnest(['Lag-Ridge','Lag-LinearReg']) AS model, unnest([1.0,0.0])::DOUBLE AS alpha)
  GROUP BY ALL),
g0 AS (SELECT series_id, k, model, list(r ORDER BY j) AS m FROM (SELECT series_id, k, model, j, r FROM ro) GROUP BY ALL),
g AS (SELECT series_id, k, model, 0::BIGINT AS p, m FROM g0 UNION ALL
  SELECT series_id, k, model, p+1, list_transform(range(1, len(m)+1), lambda r: list_transform(range(1, len(m)+2), lambda c:
    CASE WHEN r=p+1 THEN m[p+1][c]/m[p+1][p+1] ELSE m[r][c]-m[r][p+1]*m[p+1][c]/m[p+1][p+1] END)) FROM g WHERE p<len(m)),
so AS (SELECT series_id, k, model, unnest(range(1, len(m)+1)) AS j, unnest(list_transform(m, lambda r: r[-1])) AS w FROM g WHERE p=len(m)),
pl AS (SELECT ce.series_id, ce.k, model, i, any_value(y) AS y, greatest(any_value(my)+sum(c*w), 0) AS pr
  FROM ce JOIN so ON ce.series_id=so.series_id AND ce.k=so.k AND ce.j=so.j WHERE i>=a GROUP BY ALL),
lf AS (SELECT series_id, k, model, avg(abs(y-pr)) AS mae, sqrt(avg((y-pr)**2)) AS rmse, 1-sum((y-pr)**2)/nullif(var_pop(y)*count(*),0) AS r2 FROM pl GROUP BY 1,2,3),
la AS (SELECT series_id, model, avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2, count(*) AS folds FROM lf GROUP BY 1,2)"""


@query("lag_regression_series", f"""WITH RECURSIVE {ARR_SQL}, {LAG_SQL}
SELECT series_id, model, folds, round(mae,3) AS mae, round(rmse,3) AS rmse, round(r2,4) AS r2 FROM la""")
def _(spark, sf):
    df = LG.lag_benchmark(R.monthly(spark, sf), BY, kinds=("Ridge", "LinearReg"))
    return df.select("series_id", "model", "folds", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("r2", 4).alias("r2"))


@query("lag_forecast")
def _(spark, sf):
    df = LG.lag_forecast(R.monthly(spark, sf), BY, H)
    return df.select("series_id", day("month", "yyyy-MM").alias("month"), F.round("value", 3).alias("value"))


UNIFIED_SQL = f"""RECURSIVE {BENCH_SQL}, {LAG_SQL},
al AS (SELECT series_id, model, 'Traditional TS' AS family, mae, rmse, r2 FROM bm UNION ALL SELECT series_id, model, 'ML on Lags', mae, rmse, r2 FROM la),
ar3 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mae, model) AS rank FROM al),
u AS (SELECT * FROM al UNION ALL SELECT series_id, 'Ensemble(top3)', 'Ensemble', avg(mae), avg(rmse), avg(r2) FROM ar3 WHERE rank<=3 GROUP BY 1)"""


@query("ts_unified_ranking", f"""WITH {UNIFIED_SQL} SELECT series_id, model, family, round(mae,3) AS mae, round(rmse,3) AS rmse,
  row_number() OVER (PARTITION BY series_id ORDER BY mae, model) AS rank FROM u""")
def _(spark, sf):
    """Classical models and lag regressions of every series in one order."""
    from visitgrid.plans.ordered import materialize
    m = materialize(R.monthly(spark, sf))
    columns = ["series_id", "model", "family", "mae", "rmse", "r2"]
    t = TS.ts_benchmark(m, BY).withColumn("family", F.lit("Traditional TS")).select(*columns).unionByName(
        LG.lag_benchmark(m, BY, kinds=("Ridge", "LinearReg")).select(*columns))
    df = TS.ts_unified_ranking(materialize(t), BY)
    return df.select("series_id", "model", "family", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), "rank")


@query("ts_quality_gate", f"""WITH {BENCH_SQL} SELECT series_id, model, round(mae/abs((SELECT quantile_cont(o_totalprice,0.5) FROM orders)),6) AS rel_mae,
  CAST(r2>0 AND mae/abs((SELECT quantile_cont(o_totalprice,0.5) FROM orders))<0.5 AS BIGINT) AS usable FROM rk WHERE rank=1""")
def _(spark, sf):
    from visitgrid.plans.ordered import exact_quantiles
    med = exact_quantiles(R.table(spark, sf, "orders"), [], "o_totalprice", {"m": 0.5}).scalar()
    df = TS.ts_quality_gate(bench(spark, sf), med)
    return df.select("series_id", "model", r6("rel_mae").alias("rel_mae"), "usable")


@query("lag_features", f"""WITH {R.MONTHLY_SQL}, l AS (SELECT series_id, month, y, lag(y,1) OVER w AS lag_1, lag(y,2) OVER w AS lag_2, lag(y,3) OVER w AS lag_3
  FROM mo WINDOW w AS (PARTITION BY series_id ORDER BY month)) SELECT series_id, {sql_month('month')} AS month, y, lag_1, lag_2, lag_3 FROM l WHERE lag_3 IS NOT NULL""")
def _(spark, sf):
    df = TS.lag_features(R.monthly(spark, sf), BY, 3)
    return df.select("series_id", day("month", "yyyy-MM").alias("month"), "y", "lag_1", "lag_2", "lag_3")


@query("sliding_windows", f"""WITH {R.MONTHLY_SQL}, l AS (SELECT series_id, month, list(y) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS x,
  list(y) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS z FROM mo WINDOW w AS (PARTITION BY series_id ORDER BY month))
SELECT series_id, {sql_month('month')} AS month, round(list_sum(x),2) AS x_sum, x[1] AS x_first, z[3] AS y_last FROM l WHERE len(x)=12 AND len(z)=3""")
def _(spark, sf):
    df = TS.sliding_windows(R.monthly(spark, sf), BY)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return df.select("series_id", day("month", "yyyy-MM").alias("month"), F.round(total, 2).alias("x_sum"),
                     F.get("x", F.lit(0)).alias("x_first"), F.get("y_next", F.lit(2)).alias("y_last"))


@query("autocorrelation", f"""WITH {R.MONTHLY_SQL}, n AS (SELECT series_id, month, y, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i FROM mo)
SELECT a.series_id, a.i-b.i AS lag, round(corr(a.y,b.y),6)+0.0 AS acf FROM n a JOIN n b ON a.series_id=b.series_id AND a.i-b.i BETWEEN 1 AND 24 GROUP BY 1,2""")
def _(spark, sf):
    df = TS.autocorrelation(R.monthly(spark, sf), BY)
    return df.select("series_id", "lag", r6("acf").alias("acf"))


@query("demand_class", """WITH g AS (SELECT p_type AS series_id, date_trunc('month',l_shipdate) AS month, count(*) FILTER (l_quantity>=49) AS n
  FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2),
i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i FROM g),
z AS (SELECT *, i-lag(i) OVER (PARTITION BY series_id ORDER BY month) AS gap FROM i WHERE n>0),
s AS (SELECT series_id, count(*) AS n_nonzero, avg(gap) AS adi, (stddev_samp(n)/avg(n))**2 AS cv2 FROM z GROUP BY 1),
e AS (SELECT DISTINCT series_id FROM g)
SELECT e.series_id, coalesce(n_nonzero,0) AS n_nonzero, round(adi,6) AS adi, round(cv2,6) AS cv2,
  CASE WHEN coalesce(n_nonzero,0)<2 THEN 'Lumpy' WHEN adi<1.32 AND cv2<0.49 THEN 'Smooth' WHEN adi<1.32 THEN 'Erratic' WHEN cv2<0.49 THEN 'Intermittent' ELSE 'Lumpy' END AS demand_class
FROM e LEFT JOIN s ON e.series_id=s.series_id""")
def _(spark, sf):
    li = R.table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    p = R.table(spark, sf, "part").select("p_partkey", "p_type")
    g = (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
         .groupBy(F.col("p_type").alias("series_id"), F.date_trunc("month", "l_shipdate").alias("month"))
         .agg(F.count_if(F.col("l_quantity") >= 49).alias("n")))
    df = TS.demand_class(g, BY)
    return df.select("series_id", "n_nonzero", r6("adi").alias("adi"), r6("cv2").alias("cv2"), "demand_class")


@query("naive_flat_baseline", f"""WITH {R.CLEAN_SQL}, c AS (SELECT umr_art AS type, count(*)/(SELECT count(DISTINCT date_trunc('month',umr_start)) FROM cl)::DOUBLE AS a FROM cl GROUP BY 1)
SELECT type, round(a,6) AS avg_per_month, strftime(DATE '2001-08-01' + to_months(m::INTEGER), '%Y-%m') AS month, round_even(a,0)::BIGINT AS n FROM c, (SELECT unnest(range(18)) AS m)""")
def _(spark, sf):
    df = TS.naive_flat_baseline(cleaned(spark, sf), "umr_art", "umr_start", R.AS_OF)
    return df.select("type", r6("avg_per_month").alias("avg_per_month"), day("month", "yyyy-MM").alias("month"), "n")
