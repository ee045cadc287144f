"""Join, aggregate, window and encoding queries."""

from pyspark.sql import functions as F

from visitgrid import columns as C
from visitgrid.catalog.cleansing import DUR, cleaned, day
from visitgrid.catalog.registry import query
from visitgrid.catalog.stages import Stages
from visitgrid.functions.core import r6
from visitgrid.operators import aggregates as A
from visitgrid.operators import cleanse as K
from visitgrid.operators import features as FE
from visitgrid.operators import joins as J
from visitgrid.operators import sampling as S
from visitgrid.plans import roles as R
from visitgrid.plans.ordered import materialize


def keyed_entities(spark, sf):
    return K.coalesce_join_key(R.entities(spark, sf), name="jk")


def sql_month(c):
    return f"strftime({c}, '%Y-%m')"


ENT_KEY_SQL = f"{R.ENTITIES_SQL}, ek AS (SELECT *, {R.SQL_KEY} AS jk FROM ent)"
BOTH_SQL = f"{R.CLEAN_SQL}, {ENT_KEY_SQL}"
JOINED_SQL = f"""{BOTH_SQL}, dm AS (SELECT cl.*, ek.ent_id, ek.derivat, ek.bo, ek.prio,
  coalesce(ek.derivat,'UNKNOWN') AS derivat_clean FROM cl JOIN ek ON cl.jk=ek.jk)"""


def joined(spark, sf):
    df = J.inner_join_coalesce(cleaned(spark, sf), keyed_entities(spark, sf), "jk")
    return K.clean_categoricals(df, ["derivat"])


def labelled(spark, sf):
    v = cleaned(spark, sf).where(F.col("umr_start") >= F.lit(R.LABEL_FROM).cast("timestamp"))
    return J.label_semi_join(keyed_entities(spark, sf), v, "jk")


LABELLED_SQL = f"""{BOTH_SQL}, lb AS (SELECT *, CAST(jk IS NOT NULL AND jk IN
  (SELECT jk FROM cl WHERE umr_start>=TIMESTAMP '{R.LABEL_FROM}' AND jk IS NOT NULL) AS BIGINT)
  AS came_for_retrofit FROM ek)"""


# columns by rank of the type, since the type names depend on the data
TOP3_SQL = ", ".join(f"count(*) FILTER (umr_art=(SELECT umr_art FROM top WHERE r={i})) AS top_{i}" for i in (1, 2, 3)) + (
    ', count(*) FILTER (umr_art IN (SELECT umr_art FROM top WHERE r>3)) AS other')


@query("flagship_monthly_label_pivot", f"""WITH {JOINED_SQL}, lk AS (
  SELECT DISTINCT jk FROM cl WHERE umr_start>=TIMESTAMP '{R.LABEL_FROM}'),
t AS (SELECT {sql_month('umr_start')} AS month, (dm.jk IN (SELECT jk FROM lk))::BIGINT AS lab, umr_art FROM dm),
top AS (SELECT umr_art, row_number() OVER (ORDER BY count(*) DESC, umr_art) AS r FROM t GROUP BY 1)
SELECT month, lab AS came_for_retrofit, {TOP3_SQL} FROM t GROUP BY 1,2""")
def _(spark, sf):
    st = Stages(spark, sf)
    df = st.joined.join(st.labelled.select("jk", C.LABEL), "jk")
    cells = (df.groupBy(F.date_trunc("month", "umr_start").alias("month"), C.LABEL, "umr_art")
             .agg(F.count(F.lit(1)).alias("n")))
    out = A.topn_pivot(cells, ["month", C.LABEL], "umr_art", 3)
    return out.withColumn("month", day("month", "yyyy-MM")).toDF(
        "month", C.LABEL, "top_1", "top_2", "top_3", "other")


@query("label_semi_join", f"WITH {LABELLED_SQL} SELECT ent_id, jk, came_for_retrofit FROM lb")
def _(spark, sf):
    return labelled(spark, sf).select("ent_id", "jk", C.LABEL)


@query("inner_join_coalesce", f"""WITH {BOTH_SQL}
SELECT visit_id, ent_id, cl.jk, coalesce(cl.v_nummer,ek.v_nummer) AS v_nummer,
  coalesce(cl.bt_nummer,ek.bt_nummer) AS bt_nummer, umr_art, bo FROM cl JOIN ek ON cl.jk=ek.jk""")
def _(spark, sf):
    df = J.inner_join_coalesce(cleaned(spark, sf), keyed_entities(spark, sf), "jk")
    return df.select("visit_id", "ent_id", "jk", "v_nummer", "bt_nummer", "umr_art", "bo")


@query("keep_columns_projection", f"WITH {JOINED_SQL} SELECT derivat, bo, prio, umr_art FROM dm")
def _(spark, sf):
    df = J.inner_join_coalesce(cleaned(spark, sf), keyed_entities(spark, sf), "jk")
    return J.keep_columns(df, ["derivat", "bo", "prio"], ["umr_art"])


@query("map_lookup_join", """WITH m AS (SELECT c_mktsegment AS k, round(avg(c_acctbal),6) AS v FROM customer
  WHERE c_mktsegment<>'BUILDING' GROUP BY 1)
SELECT c_custkey, coalesce(v, -1.0) AS enc FROM customer LEFT JOIN m ON c_mktsegment=k""")
def _(spark, sf):
    c = R.table(spark, sf, "customer")
    m = (c.where(F.col("c_mktsegment") != "BUILDING").groupBy("c_mktsegment")
         .agg(r6(F.avg("c_acctbal")).alias("v")))
    return FE.lookup(c, m, "c_mktsegment", "c_mktsegment", "v", "enc", -1.0).select("c_custkey", "enc")


@query("nearest_month_join", f"""WITH {R.ENTITIES_SQL},
fc AS (SELECT date_trunc('quarter',o_orderdate)::TIMESTAMP AS month, sum(floor(o_totalprice))/count(*) AS value FROM orders GROUP BY 1),
p AS (SELECT ent_id, value, row_number() OVER (PARTITION BY ent_id ORDER BY
    abs(date_diff('month', month, date_trunc('month',rueckgabe_soll))), month DESC) AS rn
  FROM ent, fc WHERE rueckgabe_soll IS NOT NULL)
SELECT ent.ent_id, round(coalesce(value,(SELECT avg(value) FROM fc)),6) AS ts_value
FROM ent LEFT JOIN (SELECT * FROM p WHERE rn=1) p ON ent.ent_id=p.ent_id""")
def _(spark, sf):
    fc = (R.table(spark, sf, "orders")
          .groupBy(F.date_trunc("quarter", "o_orderdate").alias("month"))
          .agg((F.sum(F.floor("o_totalprice")) / F.count(F.lit(1))).alias("value")))
    df = J.nearest_month_value(R.entities(spark, sf), "rueckgabe_soll", fc)
    return df.select("ent_id", r6("ts_value").alias("ts_value"))


@query("outer_join_actual_pred", f"""WITH {R.CLEAN_SQL},
a AS (SELECT umr_art AS type, {sql_month('umr_start')} AS month, count(*) AS actual FROM cl GROUP BY 1,2),
p AS (SELECT umr_art AS type, {sql_month('umr_av')} AS month, count(*) AS predicted FROM cl WHERE umr_av IS NOT NULL GROUP BY 1,2)
SELECT coalesce(a.type,p.type) AS type, coalesce(a.month,p.month) AS month, coalesce(actual,0) AS actual,
  coalesce(predicted,0) AS predicted FROM a FULL JOIN p ON a.type=p.type AND a.month=p.month""")
def _(spark, sf):
    v = cleaned(spark, sf)

    def counts(c, n):
        return (v.where(F.col(c).isNotNull()).groupBy(F.col("umr_art").alias("type"), day(c, "yyyy-MM").alias("month"))
                .agg(F.count(F.lit(1)).alias(n)))
    return J.outer_join_counts(counts("umr_start", "actual"), counts("umr_av", "predicted"), ["type", "month"])


@query("first_visit_month_map", f"""WITH {R.CLEAN_SQL}
SELECT jk, {sql_month('arg_min(umr_start, visit_id)')} AS month FROM cl WHERE jk IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    df = J.first_visit_month(cleaned(spark, sf), "jk", order="visit_id")
    return df.select("jk", day("month", "yyyy-MM").alias("month"))


@query("union_history_forecast", f"""WITH {BOTH_SQL}
SELECT v_nummer, umr_status, umr_art, NULL::DOUBLE AS prob_coming FROM vis
UNION ALL SELECT v_nummer, 'Forecast', NULL, round(c_acctbal/10000,4) FROM ek""")
def _(spark, sf):
    fc = R.entities(spark, sf).select("v_nummer", F.lit(C.FORECAST).alias("umr_status"),
                                      F.round(F.col("c_acctbal") / 10000, 4).alias("prob_coming"))
    hist = R.visits(spark, sf).select("v_nummer", "umr_status", "umr_art")
    return J.union_history_forecast(hist, fc, ["v_nummer", "umr_status", "umr_art", "prob_coming"])


@query("exclude_known_types", """WITH k AS (SELECT p_type FROM part GROUP BY 1 HAVING avg(p_retailprice)>(SELECT avg(p_retailprice) FROM part))
SELECT p_partkey, p_type FROM part WHERE p_type NOT IN (SELECT p_type FROM k) OR p_type IS NULL""")
def _(spark, sf):
    p = R.table(spark, sf, "part")
    mean = p.agg(F.avg("p_retailprice")).scalar()
    known = p.groupBy("p_type").agg(F.avg("p_retailprice").alias("m")).where(F.col("m") > mean)
    return J.split_known(p, "p_type", known, "p_type")[1].select("p_partkey", "p_type")


# -- aggregates ------------------------------------------------------------

@query("missing_pct", f"""WITH {R.ENTITIES_SQL}, m AS (
  SELECT unnest(['derivat','rueckgabe_soll','av_fzg','hybrid','motortyp']) AS "column",
    unnest([avg((derivat IS NULL)::INT), avg((rueckgabe_soll IS NULL)::INT), avg((av_fzg IS NULL)::INT),
      avg((hybrid IS NULL)::INT), avg((motortyp IS NULL)::INT)])*100 AS missing_pct FROM ent)
SELECT "column", round(missing_pct,6) AS missing_pct FROM m WHERE missing_pct>0""")
def _(spark, sf):
    df = A.missing_pct(R.entities(spark, sf))
    return df.select("column", r6("missing_pct").alias("missing_pct"))


def _desc_sql(c):
    return (f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}),3) AS mean, round(stddev_samp({c}),3) AS std, "
            f"round(min({c})::DOUBLE,3) AS min, round(quantile_cont({c}::DOUBLE,0.25),3) AS q25, round(quantile_cont({c}::DOUBLE,0.5),3) AS q50, "
            f"round(quantile_cont({c}::DOUBLE,0.75),3) AS q75, round(max({c})::DOUBLE,3) AS max FROM lineitem")


@query("describe_numeric", " UNION ALL ".join(_desc_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")))
def _(spark, sf):
    return A.describe_numeric(R.table(spark, sf, "lineitem"),
                              ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"])


@query("feature_histogram", """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT least(floor((value-lo)/((hi-lo)/20.0))::BIGINT+1, 20) AS bin, count(*) AS n FROM events, e GROUP BY 1""")
def _(spark, sf):
    return A.histogram(R.table(spark, sf, "events"), "value", 20)


@query("target_distribution", f"""WITH {R.CLEAN_SQL}, c AS (SELECT umr_art AS class, count(*) AS n FROM cl GROUP BY 1)
SELECT class, n, round(n/(SELECT sum(n) FROM c),6) AS share, round((SELECT max(n) FROM c)/n,6) AS imbalance FROM c""")
def _(spark, sf):
    df = A.target_distribution(cleaned(spark, sf), "umr_art")
    return df.select("class", "n", r6("share").alias("share"), r6("imbalance").alias("imbalance"))


@query("monthly_volume", f"WITH {R.CLEAN_SQL} SELECT {sql_month('umr_start')} AS month, count(*) AS n FROM cl GROUP BY 1")
def _(spark, sf):
    return A.monthly_volume(cleaned(spark, sf)).select(day("month", "yyyy-MM").alias("month"), "n")


@query("monthly_volume_topn_pivot", f"""WITH {R.CLEAN_SQL},
top AS (SELECT umr_art, row_number() OVER (ORDER BY count(*) DESC, umr_art) AS r FROM cl GROUP BY 1)
SELECT {sql_month('umr_start')} AS month, {TOP3_SQL} FROM cl GROUP BY 1""")
def _(spark, sf):
    df = A.monthly_volume_topn_pivot(cleaned(spark, sf), n=3)
    return df.withColumn("month", day("month", "yyyy-MM")).toDF("month", "top_1", "top_2", "top_3", "other")


@query("historical_pivot", f"""WITH {R.CLEAN_SQL}
SELECT {sql_month('umr_start')} AS month, {", ".join(
    f"count(*) FILTER (umr_art='{p}') AS \"{p}\"" for p in R.PACKAGES)} FROM cl GROUP BY 1""")
def _(spark, sf):
    df = A.historical_pivot(cleaned(spark, sf), types=R.PACKAGES)
    return df.withColumn("month", day("month", "yyyy-MM"))


@query("group_count_transform", f"""WITH {R.CLEAN_SQL}
SELECT visit_id, count(*) OVER (PARTITION BY date_trunc('month',umr_start), umr_art) AS monthly_retrofit_count FROM cl""")
def _(spark, sf):
    return A.group_count_transform(cleaned(spark, sf)).select("visit_id", "monthly_retrofit_count")


def _fs(c):
    return f"CASE WHEN {c} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY {c}) END"


@query("fleet_size", f"""WITH {R.ENTITIES_SQL} SELECT ent_id, {_fs('derivat')} AS derivat_fleet_size,
  {_fs('motortyp')} AS motortyp_fleet_size, {_fs('bo')} AS bo_fleet_size FROM ent""")
def _(spark, sf):
    names = {c: f"{c}_fleet_size" for c in ("derivat", "motortyp", "bo")}
    return A.fleet_size(R.entities(spark, sf), names).select("ent_id", *names.values())


@query("common_flag", f"""WITH {R.ENTITIES_SQL}, c AS (SELECT bo, count(*) AS n FROM ent WHERE bo IS NOT NULL GROUP BY 1)
SELECT ent_id, CAST(coalesce(c.n,0) > (SELECT quantile_cont(n,0.5) FROM c) AS BIGINT) AS is_common_bo
FROM ent LEFT JOIN c ON ent.bo=c.bo""")
def _(spark, sf):
    return A.common_flag(R.entities(spark, sf), "bo", "is_common_bo").select("ent_id", "is_common_bo")


@query("frequency_feature", f"""WITH {R.ENTITIES_SQL}
SELECT ent_id, round({_fs('derivat')}/(SELECT count(derivat) FROM ent),6) AS derivat_freq,
  round({_fs('motortyp')}/(SELECT count(motortyp) FROM ent),6) AS motortyp_freq FROM ent""")
def _(spark, sf):
    df = A.frequency_feature(R.entities(spark, sf), {"derivat": "derivat_freq", "motortyp": "motortyp_freq"})
    return df.select("ent_id", r6("derivat_freq").alias("derivat_freq"), r6("motortyp_freq").alias("motortyp_freq"))


@query("engineer_features", f"""WITH {R.ENTITIES_SQL},
a AS (SELECT *, coalesce(CAST(floor((epoch_us(sop)-epoch_us(TIMESTAMP '{R.AS_OF}'))/86400000000.0) AS BIGINT)/30.44,0) AS va,
  {_fs('derivat')} AS fs FROM ent),
c AS (SELECT derivat, count(*) AS n FROM ent WHERE derivat IS NOT NULL GROUP BY 1)
SELECT ent_id, round(va,6) AS vehicle_age_months, fs AS derivat_fleet_size,
  CAST(fs>(SELECT quantile_cont(n,0.5) FROM c) AS BIGINT) AS is_common_derivat,
  round(fs/(SELECT count(derivat) FROM ent),6) AS derivat_freq, round(va*fs,6)+0.0 AS age_x_fleet,
  coalesce(derivat,'UNKNOWN')||'_'||basistyp AS derivat_x_basistyp, coalesce(hybrid,'UNKNOWN') AS hybrid_clean FROM a""")
def _(spark, sf):
    from visitgrid.operators.engineer import engineer_features
    df = engineer_features(R.entities(spark, sf), R.AS_OF)
    return df.select("ent_id", r6("vehicle_age_months").alias("vehicle_age_months"), "derivat_fleet_size",
                     "is_common_derivat", r6("derivat_freq").alias("derivat_freq"),
                     r6("age_x_fleet").alias("age_x_fleet"), "derivat_x_basistyp", "hybrid_clean")


def split_entities(spark, sf):
    df = K.clean_categoricals(labelled(spark, sf), ["derivat", "bo", "motortyp"])
    # fitted on and applied to: written once, with the columns that the encodings read
    return materialize(S.hash_split(df, "ent_id").select("ent_id", "split", C.LABEL, "derivat_clean", "bo", "motortyp_clean"))


SPLIT_SQL = f"""{LABELLED_SQL}, sp AS (SELECT *, CASE WHEN {R.MD5.format('ent_id')}%100<20 THEN 'test' ELSE 'train' END AS split,
  coalesce(derivat,'UNKNOWN') AS derivat_clean, coalesce(motortyp,'UNKNOWN') AS motortyp_clean FROM lb)"""


def _te_sql(c, y, smooth):
    enc = f"avg({y})" if smooth is None else (
        f"count(*)/(count(*)+{smooth}.0)*avg({y})+(1-count(*)/(count(*)+{smooth}.0))*(SELECT avg({y}) FROM sp WHERE split='train')")
    return f"(SELECT {c} AS k, {enc} AS enc FROM sp WHERE split='train' GROUP BY 1)"


def _te_query(smooth):
    y = "came_for_retrofit"
    return f"""WITH {SPLIT_SQL}
SELECT ent_id, split, round(coalesce(a.enc,(SELECT avg({y}) FROM sp WHERE split='train')),6) AS derivat_clean,
  round(coalesce(b.enc,(SELECT avg({y}) FROM sp WHERE split='train')),6) AS bo
FROM sp LEFT JOIN {_te_sql('derivat_clean', y, smooth)} a ON derivat_clean=a.k
LEFT JOIN {_te_sql('bo', y, smooth)} b ON bo=b.k"""


def _te(spark, sf, smooth):
    df = FE.target_encode(split_entities(spark, sf), ["derivat_clean", "bo"], C.LABEL, smoothing=smooth)
    return df.select("ent_id", "split", r6("derivat_clean").alias("derivat_clean"), r6("bo").alias("bo"))


@query("target_encode", _te_query(None))
def _(spark, sf):
    return _te(spark, sf, None)


@query("smoothed_target_encode", _te_query(20))
def _(spark, sf):
    return _te(spark, sf, 20)


@query("frequency_encode", f"""WITH {SPLIT_SQL}
SELECT ent_id, round(coalesce(n/(SELECT count(*) FROM sp WHERE split='train'),0),6) AS motortyp_clean_freq
FROM sp LEFT JOIN (SELECT motortyp_clean AS k, count(*) AS n FROM sp WHERE split='train' GROUP BY 1) ON motortyp_clean=k""")
def _(spark, sf):
    df = FE.frequency_encode(split_entities(spark, sf), ["motortyp_clean"])
    return df.select("ent_id", r6("motortyp_clean_freq").alias("motortyp_clean_freq"))


@query("group_target_stats", f"""WITH {R.DURATIONS_SQL},
g AS (SELECT type, quantile_cont(y,0.5) AS m, count(*) AS n FROM du WHERE split='train' AND type<>'R/O' GROUP BY 1)
SELECT id, du.type, y, round(coalesce(m,(SELECT quantile_cont(y,0.5) FROM du WHERE split='train' AND type<>'R/O')),6) AS type_hist_median,
  coalesce(n,0) AS type_hist_count FROM du LEFT JOIN g ON du.type=g.type""")
def _(spark, sf):
    d = R.durations(spark, sf)
    d = d.withColumn("split", F.when((F.col("split") == "train") & (F.col("type") != "R/O"), F.lit("train"))
                     .otherwise(F.lit("test")))
    df = FE.group_target_stats(d, "y", "type")
    return df.select("id", "type", "y", r6("type_hist_median").alias("type_hist_median"), "type_hist_count")


@query("standalone_rare_remap", f"""WITH {R.WIDE_SQL}, c AS (SELECT cls, count(*) AS n FROM wp GROUP BY 1),
alone AS (SELECT cls AS part, n FROM c WHERE NOT contains(cls,', ')),
rare AS (SELECT cls FROM c WHERE contains(cls,', ') AND n<greatest(50, floor((SELECT sum(n) FROM c)*0.005))),
parts AS (SELECT cls, unnest(string_split(cls,', ')) AS part, unnest(range(len(string_split(cls,', ')))) AS i FROM rare),
best AS (SELECT cls, part, row_number() OVER (PARTITION BY cls ORDER BY coalesce(n,0), i) AS rn
  FROM parts LEFT JOIN alone USING (part))
SELECT id, coalesce(b.part, wp.cls) AS cls FROM wp LEFT JOIN (SELECT * FROM best WHERE rn=1) b ON wp.cls=b.cls""")
def _(spark, sf):
    return FE.standalone_rare_remap(R.wide_packages(spark, sf), "cls")


@query("filter_rare_classes", f"""WITH {R.WIDE_SQL}, c AS (SELECT cls, count(*) AS n FROM wp GROUP BY 1)
SELECT id, cls FROM wp WHERE cls IN (SELECT cls FROM c WHERE n>=greatest(100, floor((SELECT sum(n) FROM c)*0.02)))""")
def _(spark, sf):
    return FE.filter_rare_classes(R.wide_packages(spark, sf), "cls", 100, 0.02)


@query("label_encode", f"""WITH {R.CLEAN_SQL}, c AS (SELECT umr_art, row_number() OVER (ORDER BY umr_art)-1 AS code
  FROM (SELECT umr_art FROM cl GROUP BY 1 HAVING count(*)>=greatest(10, floor((SELECT count(*) FROM cl)*0.001)))) SELECT visit_id, cl.umr_art, code FROM cl JOIN c ON cl.umr_art=c.umr_art""")
def _(spark, sf):
    return FE.label_encode(cleaned(spark, sf).select("visit_id", "umr_art"), "umr_art").select("visit_id", "umr_art", "code")


@query("duration_target", f"""WITH {R.CLEAN_SQL}, d AS (SELECT visit_id, {DUR}::DOUBLE AS d FROM cl),
p AS (SELECT * FROM d WHERE d>=0)
SELECT visit_id, d AS retrofit_duration_days FROM p WHERE d BETWEEN (SELECT quantile_cont(d,0.01) FROM p) AND (SELECT quantile_cont(d,0.99) FROM p)""")
def _(spark, sf):
    return FE.duration_target(cleaned(spark, sf)).select("visit_id", C.DURATION)


TS_AGG = "round(avg(y),6) AS mean, round(stddev_samp(y),6) AS std, count(*) AS count, round(quantile_cont(y,0.5),6) AS median"


@query("type_stats", f"WITH {R.DURATIONS_SQL} SELECT type, {TS_AGG} FROM du GROUP BY 1")
def _(spark, sf):
    df = A.type_stats(R.durations(spark, sf), "type", "y")
    return df.select("type", "count", *[r6(c).alias(c) for c in ("mean", "std", "median")])


def type_mapping(visits):
    """Package -> coarse group table, from the packages that occur."""
    v = visits.select(F.col("umr_art").alias("package")).distinct()
    g = F.when(F.col("package").contains("R"), F.lit("with R")).when(
        F.col("package").contains("A"), F.lit("with A"))
    return v.select("package", g.alias("type_group")).where(F.col("type_group").isNotNull())


TYPE_GROUP_SQL = "CASE WHEN contains(umr_art,'R') THEN 'with R' WHEN contains(umr_art,'A') THEN 'with A' END"


@query("type_group_mapping", f"""WITH {R.CLEAN_SQL} SELECT {TYPE_GROUP_SQL} AS type_group,
  quantile_cont(cost,0.5) AS median, round(sum(cost),2) AS total, count(*) AS count
FROM cl WHERE umr_status='Completed' AND {TYPE_GROUP_SQL} IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    v = cleaned(spark, sf)
    done = v.where(F.col("umr_status") == C.COMPLETED)
    df = A.type_stats(A.with_type_group(done, type_mapping(v)), "type_group", "cost")
    return df.select("type_group", "median", F.round(F.col("mean") * F.col("count"), 2).alias("total"), "count")


@query("visit_stats", f"""WITH {JOINED_SQL}, p AS (SELECT jk, count(*) AS n FROM dm GROUP BY 1)
SELECT count(*) AS entities, round(avg(n),6) AS mean, max(n) AS max, quantile_cont(n,0.5)::DOUBLE AS median FROM p""")
def _(spark, sf):
    df = A.visit_stats(joined(spark, sf), "jk")
    return df.select("entities", r6("mean").alias("mean"), "max", "median")


@query("visit_distribution", f"""WITH {JOINED_SQL}, p AS (SELECT jk, count(*) AS n FROM dm GROUP BY 1)
SELECT n AS visits, count(*) AS entities FROM p GROUP BY 1""")
def _(spark, sf):
    return A.visit_distribution(joined(spark, sf), "jk")


@query("visits_per_category", f"""WITH {JOINED_SQL}, p AS (SELECT jk, min(derivat_clean) AS derivat_clean, count(*) AS n FROM dm GROUP BY 1)
SELECT derivat_clean, round(avg(n),6) AS mean_visits FROM p GROUP BY 1""")
def _(spark, sf):
    df = A.visits_per_category(joined(spark, sf), "derivat_clean", "jk")
    return df.select("derivat_clean", r6("mean_visits").alias("mean_visits"))


@query("monthly_series", f"""WITH {R.CLEAN_SQL} SELECT {sql_month('umr_start')} AS month, count(*) AS n,
  round(sum(cost),2) AS total FROM cl WHERE cost IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    df = A.monthly_series(cleaned(spark, sf), "cost")
    return df.select(day("month", "yyyy-MM").alias("month"), "n", F.round(F.col("mean_target") * F.col("n"), 2).alias("total"))


@query("class_feature_summary", """
WITH m AS (SELECT c_mktsegment AS label, round(avg(c_acctbal),6) AS mean FROM customer GROUP BY 1),
c AS (SELECT c_mktsegment AS label, n_name AS v, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2),
b AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY n DESC, v) AS rn FROM c)
SELECT label, 'c_acctbal' AS feature, mean, NULL AS mode FROM m
UNION ALL SELECT label, 'n_name', NULL, v FROM b WHERE rn=1""")
def _(spark, sf):
    c = R.table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "label")
    c = c.join(R.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    df = A.class_feature_summary(c, "label", ["c_acctbal"], ["n_name"])
    return df.withColumn("mean", r6("mean"))


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE,{b}::DOUBLE),6)+0.0 AS corr FROM lineitem"
    for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i:]))
def _(spark, sf):
    df = A.correlation_matrix(R.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return df.withColumn("corr", r6("corr"))


def _drift_sql(c):
    return f"""SELECT '{c}' AS feature, abs(avg({c}) FILTER (split='test')-avg({c}) FILTER (split='train'))
  /greatest(stddev_samp({c}) FILTER (split='train'),1e-8) AS z FROM du"""


@query("train_test_drift", f"""WITH {R.DURATIONS_SQL}, x AS ({_drift_sql('y')} UNION ALL {_drift_sql('yhat')} UNION ALL {_drift_sql('yhat2')})
SELECT feature, round(z,6) AS z, CAST(z>1 AS BIGINT) AS drifted FROM x""")
def _(spark, sf):
    df = A.train_test_drift(R.durations(spark, sf), ["y", "yhat", "yhat2"])
    return df.select("feature", r6("z").alias("z"), "drifted")


@query("majority_vote", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1,2),
b AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c),
m AS (SELECT user_id, round(avg(value),4) AS probability, count(*) AS votes FROM events GROUP BY 1)
SELECT m.user_id, event_type AS prediction, probability, votes FROM m JOIN b ON m.user_id=b.user_id AND rn=1""")
def _(spark, sf):
    df = A.majority_vote(R.table(spark, sf, "events"), "user_id", "event_type", "value")
    return df.withColumn("probability", F.round("probability", 4))


def _mi_sql(c):
    tenths = ",".join(f"{i / 10}" for i in range(1, 10))
    return f"""SELECT '{c}' AS feature, o AS label, 1+len(list_filter(list_distinct(edges), lambda e: v>e)) AS bin
  FROM (SELECT {c}::DOUBLE AS v, l_returnflag AS o FROM lineitem), (SELECT quantile_cont({c}::DOUBLE,[{tenths}]) AS edges FROM lineitem)"""


@query("mutual_info_topk", f"""WITH b AS ({_mi_sql('l_quantity')} UNION ALL {_mi_sql('l_extendedprice')} UNION ALL {_mi_sql('l_partkey')}),
c AS (SELECT feature, label, bin, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature,bin) AS nx, sum(n) OVER (PARTITION BY feature,label) AS ny,
  sum(n) OVER (PARTITION BY feature) AS nn FROM c),
m AS (SELECT feature, sum(n/nn*ln(n*nn/(nx*ny))) AS mi FROM t GROUP BY 1)
SELECT 'l_linestatus' AS feature, 'categorical' AS kind, NULL::DOUBLE AS mi
UNION ALL (SELECT feature, 'numeric', round(mi,6) FROM m ORDER BY mi DESC, feature LIMIT 2)""")
def _(spark, sf):
    df = A.mutual_info_topk(R.table(spark, sf, "lineitem"), "l_returnflag",
                            ["l_quantity", "l_extendedprice", "l_partkey"], ["l_linestatus"], k=3)
    return df.withColumn("mi", r6("mi"))


# -- windows ----------------------------------------------------------------

GAPS_SQL = f"""{JOINED_SQL}, gp AS (SELECT jk, derivat_clean, CAST(floor((epoch_us(umr_start)-epoch_us(lag(umr_start)
  OVER (PARTITION BY jk ORDER BY umr_start, derivat_clean)))/86400000000.0) AS BIGINT) AS gap FROM dm)"""


@query("inter_visit_gap", f"""WITH {GAPS_SQL} SELECT count(*) AS n, round(avg(gap),6) AS mean_days,
  quantile_cont(gap,0.5)::DOUBLE AS median_days FROM gp WHERE gap>0 AND gap<1000""")
def _(spark, sf):
    df = A.inter_visit_gap(joined(spark, sf), "jk")
    return df.select("n", r6("mean_days").alias("mean_days"), "median_days")


@query("inter_visit_gap_by_category", f"""WITH {GAPS_SQL} SELECT derivat_clean, quantile_cont(gap,0.5)::DOUBLE AS median_days
FROM gp WHERE gap BETWEEN 1 AND 999 GROUP BY 1""")
def _(spark, sf):
    return A.inter_visit_gap_by_category(joined(spark, sf), "derivat_clean", "jk")


# -- splits and samples -------------------------------------------------------

@query("stratified_split", f"""WITH {R.SCORED_SQL}, r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {R.MD5.format('id')}, id) AS i,
  count(*) OVER (PARTITION BY y) AS n FROM sc)
SELECT id, y, CASE WHEN i<=round_even(n*0.2,0) THEN 'test' ELSE 'train' END AS split FROM r""")
def _(spark, sf):
    return S.stratified_split(R.scored(spark, sf).select("id", "y"), "id", "y")


@query("hash_split", f"SELECT o_orderkey AS id, CASE WHEN {R.MD5.format('o_orderkey')}%100<20 THEN 'test' ELSE 'train' END AS split FROM orders")
def _(spark, sf):
    return S.hash_split(R.scored(spark, sf).select("id"), "id")


@query("stratified_kfold", f"""WITH {R.SCORED_SQL}
SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY {R.MD5.format('id')}, id)-1)%3 AS fold FROM sc""")
def _(spark, sf):
    return S.stratified_kfold(R.scored(spark, sf).select("id", "y"), "id", "y", 3)


@query("chronological_split", f"""WITH {R.MONTHLY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i,
  count(*) OVER (PARTITION BY series_id) AS c FROM mo)
SELECT series_id, {sql_month('month')} AS month, CASE WHEN i<=greatest(floor(c*0.8),6) THEN 'train' ELSE 'test' END AS split FROM r""")
def _(spark, sf):
    df = S.chronological_split(R.monthly(spark, sf), ["series_id"], min_train=6)
    return df.select("series_id", day("month", "yyyy-MM").alias("month"), "split")


@query("walk_forward_folds", f"""WITH RECURSIVE {R.MONTHLY_SQL}, l AS (SELECT series_id, count(*)-6 AS n, greatest(8, (count(*)-6)//3) AS mt,
  greatest(1,(count(*)-6)//6) AS sz FROM mo GROUP BY 1),
f AS (SELECT series_id, n, unnest(range(greatest(1,(n-mt)//sz))) AS k, mt, sz FROM l),
g AS (SELECT series_id, n, k AS fold, mt+k*sz AS train_end, mt+(k+1)*sz AS test_end FROM f WHERE mt+(k+1)*sz<=n),
t AS (SELECT series_id, n, max(fold)+1 AS fold, max(test_end) AS train_end, n AS test_end FROM g GROUP BY 1,2 HAVING max(test_end)<n)
SELECT * FROM g UNION ALL SELECT * FROM t""")
def _(spark, sf):
    lengths = R.monthly(spark, sf).groupBy("series_id").agg((F.count(F.lit(1)) - 6).alias("n"))
    return S.walk_forward_folds(lengths, n_lags=6)


@query("cap_sample", f"""WITH {R.SCORED_SQL}, r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {R.MD5.format('id')}, id) AS i,
  count(*) OVER (PARTITION BY y) AS n, count(*) OVER () AS t FROM sc)
SELECT id, y FROM r WHERE i<=CASE WHEN t<=500 THEN n ELSE round_even(n*500.0/t,0) END""")
def _(spark, sf):
    return S.cap_sample(R.scored(spark, sf).select("id", "y"), "id", "y", 500)


_KNN_SQL = """pairs AS (SELECT q.vec_id AS q_id, b.vec_id AS b_id, b.label, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]),9) AS score
  FROM embeddings q JOIN embeddings b ON q.vec_id<>b.vec_id)"""


@query("nearest_examples_per_class", f"""WITH {_KNN_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY score DESC, b_id) AS rn FROM pairs)
SELECT q_id, label, b_id, rn, round(score,6) AS score FROM r WHERE rn<=2""")
def _(spark, sf):
    from visitgrid.plans.neighbors import nearest
    e = R.table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b_vec"), "label")
    df = nearest(q, b, 2, group="label")
    return df.select("q_id", "label", "b_id", "rn", r6("score").alias("score"))


@query("nearest_examples_indexed", """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT sum(least(n-1, 5)*n)::BIGINT AS n_exact, 1 AS reached FROM c""")
def _(spark, sf):
    """The index against the exact search, within classes: all exact pairs, and whether 0.9 of them are found."""
    from visitgrid.plans.neighbors import nearest, nearest_indexed, recall
    e = materialize(R.table(spark, sf, "embeddings"))
    q = e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"), "label")
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b_vec"), "label")
    exact = nearest(q, b, 5, group="label").join(q.select("q_id", F.col("label").alias("own")), "q_id").where("label = own")
    r = recall(nearest_indexed(q, b, 5, within="label", bucket_rows=32), materialize(exact))
    return r.select("n_exact", (F.col("recall") >= 0.9).cast("int").alias("reached"))


_CLASS_SMOTE_SQL = f"""c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
ne AS (SELECT label, n, greatest(floor((SELECT max(n) FROM c)*1.0)::BIGINT-n, 0) AS need, least(5, n-1) AS k FROM c),
mi AS (SELECT vec_id, e.label, embedding::DOUBLE[] AS v, n, need, k, row_number() OVER (PARTITION BY e.label ORDER BY {R.MD5.format('vec_id')}, vec_id)-1 AS pos
  FROM embeddings e JOIN ne ON e.label=ne.label WHERE need>0 AND k>0),
pr AS (SELECT a.vec_id AS q_id, b.vec_id AS b_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY
   round(list_distance(a.v,b.v)**2,9), b.vec_id) AS rn FROM mi a JOIN mi b ON a.label=b.label AND a.vec_id<>b.vec_id),
cp AS (SELECT vec_id, label, v, k, unnest(range(1, 1+(need//n + CASE WHEN pos<need%n THEN 1 ELSE 0 END))) AS copy FROM mi),
st AS (SELECT *, {R.MD5.format("vec_id||'-'||copy")}%k+1 AS rn, ({R.MD5.format("vec_id||'-'||copy||'s'")}+0.5)/4294967296.0::DOUBLE AS step FROM cp)"""


@query("smote_classes", f"""WITH {_CLASS_SMOTE_SQL}
SELECT st.vec_id, st.label, st.copy, b_id AS neighbour, round(st.v[1]+step*(mi.v[1]-st.v[1]),5) AS v1, round(st.v[64]+step*(mi.v[64]-st.v[64]),5) AS v64
FROM st JOIN pr ON pr.q_id=st.vec_id AND pr.rn=st.rn JOIN mi ON mi.vec_id=b_id""")
def _(spark, sf):
    e = R.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    df = S.smote_classes(e, "vec_id", "embedding", "label", ratio=1.0)
    return df.select("vec_id", "label", "copy", "neighbour",
                     *[(F.round(F.get("embedding", F.lit(i)), 5) + F.lit(0.0)).alias(n) for i, n in ((0, "v1"), (63, "v64"))])


@query("smote", f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
par AS (SELECT (SELECT n FROM c WHERE label=3) AS nmin, floor((SELECT max(n) FROM c WHERE label<>3)*2.0)::BIGINT AS goal),
mi AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY {R.MD5.format('vec_id')}, vec_id) AS pos FROM embeddings WHERE label=3),
pr AS (SELECT a.vec_id AS q_id, b.vec_id AS b_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY
   round(list_distance(a.v,b.v)**2,9), b.vec_id) AS rn FROM mi a JOIN mi b ON a.vec_id<>b.vec_id),
cp AS (SELECT vec_id, v, unnest(range(1, 1+((goal-nmin)//nmin + CASE WHEN pos<=(goal-nmin)%nmin THEN 1 ELSE 0 END))) AS copy FROM mi, par WHERE goal>nmin),
st AS (SELECT *, {R.MD5.format("vec_id||'-'||copy")}%5+1 AS rn, ({R.MD5.format("vec_id||'-'||copy||'s'")}+0.5)/4294967296.0::DOUBLE AS step FROM cp)
SELECT st.vec_id, st.copy, b_id AS neighbour, round(st.v[1]+step*(mi.v[1]-st.v[1]),5) AS v1, round(st.v[64]+step*(mi.v[64]-st.v[64]),5) AS v64
FROM st JOIN pr ON pr.q_id=st.vec_id AND pr.rn=st.rn JOIN mi ON mi.vec_id=b_id""")
def _(spark, sf):
    e = R.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    df = S.smote(e, "vec_id", "embedding", "label", 3, ratio=2.0)
    return df.select("vec_id", "copy", "neighbour",
                     *[(F.round(F.get("embedding", F.lit(i)), 5) + F.lit(0.0)).alias(n)
                       for i, n in ((0, "v1"), (63, "v64"))])
