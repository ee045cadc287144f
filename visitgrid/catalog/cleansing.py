"""Projection, filter and text queries."""

from pyspark.sql import functions as F

from visitgrid import columns as C
from visitgrid.catalog.registry import query
from visitgrid.functions import text as X
from visitgrid.functions.core import r6
from visitgrid.operators import aggregates as A
from visitgrid.operators import cleanse as K
from visitgrid.operators import features as FE
from visitgrid.plans import roles as R


def cleaned(spark, sf, visits=None):
    """Raw visits (``visits``, if already at hand) through the whole cleansing chain, with the join key as ``jk``."""
    # blank packages stay blank under normalisation, so both filters run before the shuffle
    df = K.filter_blank_package(K.filter_not_status(R.visits(spark, sf) if visits is None else visits))
    df = K.normalize_package(K.dedup_rows(df))
    return K.coalesce_join_key(df, name="jk")


def day(c, fmt="yyyy-MM-dd"):
    return F.date_format(c, fmt)


@query("filter_not_status", f"""WITH {R.VISITS_SQL}
SELECT visit_id, umr_status FROM vis WHERE umr_status IS DISTINCT FROM 'Cancelled'""")
def _(spark, sf):
    return K.filter_not_status(R.visits(spark, sf)).select("visit_id", "umr_status")


@query("dedup_rows", """WITH twice AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey%3=0)
SELECT DISTINCT * REPLACE (strftime(l_shipdate,'%Y-%m-%d') AS l_shipdate) FROM twice""")
def _(spark, sf):
    """Whole rows; a third of the table stands there twice."""
    li = R.table(spark, sf, "lineitem")
    df = K.dedup_rows(li.unionByName(li.where("l_orderkey % 3 = 0")))
    return df.withColumn("l_shipdate", day("l_shipdate"))


@query("normalize_package", f"""WITH {R.VISITS_SQL}
SELECT visit_id, {R.SQL_PACKAGE} AS umr_art FROM vis""")
def _(spark, sf):
    return K.normalize_package(R.visits(spark, sf)).select("visit_id", "umr_art")


@query("filter_invalid_packages", f"""WITH {R.VISITS_SQL}
SELECT visit_id, umr_art FROM vis WHERE umr_art IS NULL OR umr_art NOT IN ('R,N', 'N,A')""")
def _(spark, sf):
    df = K.filter_invalid_packages(R.visits(spark, sf), ["R,N", "N,A"])
    return df.select("visit_id", "umr_art")


@query("filter_blank_package", f"""WITH {R.VISITS_SQL}
SELECT visit_id, umr_art FROM vis WHERE umr_art IS NOT NULL AND trim(umr_art) NOT IN ('','nan','<NA>')""")
def _(spark, sf):
    return K.filter_blank_package(R.visits(spark, sf)).select("visit_id", "umr_art")


@query("parse_dates_coerce", """
SELECT event_id, strftime(try_cast(CASE WHEN event_id%10=3 THEN 'garbage '||event_id
    WHEN event_id%10=4 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP),
  '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def _(spark, sf):
    e = R.table(spark, sf, "events")
    raw = (F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("garbage "), F.col("event_id")))
           .when(F.col("event_id") % 10 == 4, F.lit(""))
           .otherwise(day("ts", "yyyy-MM-dd HH:mm:ss")))
    df = K.parse_dates(e.select("event_id", raw.alias("parsed")), ["parsed"])
    return df.select("event_id", day("parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("calendar_parts", """
SELECT o_orderkey, month(o_orderdate)::INTEGER AS month, quarter(o_orderdate)::INTEGER AS quarter,
  year(o_orderdate)::INTEGER AS year, (isodow(o_orderdate)-1)::INTEGER AS day_of_week,
  weekofyear(o_orderdate)::INTEGER AS week_of_year FROM orders""")
def _(spark, sf):
    o = R.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return K.calendar_parts(o, "o_orderdate").drop("o_orderdate")


SQL_DAYS = "CAST(floor((epoch_us({})-epoch_us({}))/86400000000.0) AS BIGINT)"
DUR = SQL_DAYS.format("umr_av", "umr_start")
AS_OF_SQL = f"TIMESTAMP '{R.AS_OF}'"


@query("lead_time_bucket", f"""WITH {R.VISITS_SQL}
SELECT visit_id, CASE WHEN {DUR}<=-5 THEN 'early' WHEN {DUR}<=5 THEN 'on_time'
  WHEN {DUR}<=15 THEN 'slight_delay' WHEN {DUR} IS NOT NULL THEN 'major_delay' END
  AS lead_time_category FROM vis""")
def _(spark, sf):
    return K.lead_time_bucket(R.visits(spark, sf)).select("visit_id", "lead_time_category")


@query("coalesce_join_key", f"""WITH {R.ENTITIES_SQL}
SELECT ent_id, {R.SQL_KEY} AS join_key, {R.sql_key('v_nummer','bt_nummer','at_nummer')}
  AS effective_key FROM ent""")
def _(spark, sf):
    df = K.coalesce_join_key(R.entities(spark, sf), name="join_key")
    df = K.coalesce_join_key(df, C.KEY_CHAIN_EFFECTIVE, "effective_key")
    return df.select("ent_id", "join_key", "effective_key")


@query("join_key_usage", f"""WITH {R.ENTITIES_SQL}
SELECT CASE WHEN at_nummer NOT IN ('','0') THEN 'at_nummer' WHEN bt_nummer NOT IN ('','0')
  THEN 'bt_nummer' WHEN v_nummer NOT IN ('','0') THEN 'v_nummer' ELSE 'none' END AS key_column,
  count(*) AS n FROM ent GROUP BY 1""")
def _(spark, sf):
    return K.join_key_usage(R.entities(spark, sf))


@query("clean_categoricals", f"""WITH {R.ENTITIES_SQL}
SELECT ent_id, coalesce(derivat,'UNKNOWN') AS derivat_clean, coalesce(hybrid,'UNKNOWN') AS hybrid_clean,
  coalesce(motortyp,'UNKNOWN') AS motortyp_clean FROM ent""")
def _(spark, sf):
    df = K.clean_categoricals(R.entities(spark, sf), ["derivat", "hybrid", "motortyp"])
    return df.select("ent_id", "derivat_clean", "hybrid_clean", "motortyp_clean")


def _age(c):
    return f"coalesce({SQL_DAYS.format(c, AS_OF_SQL)}/30.44, 0)"


AGES_SQL = f"""ages AS (SELECT *, {_age('sop')} AS va, {_age('av_fzg')} AS ca FROM ent)"""


def aged(spark, sf):
    return K.age_months(R.entities(spark, sf), R.AS_OF)


@query("age_months", f"""WITH {R.ENTITIES_SQL}, {AGES_SQL}
SELECT ent_id, round(va,6) AS vehicle_age_months, round(ca,6) AS car_ready_age_months FROM ages""")
def _(spark, sf):
    return aged(spark, sf).select("ent_id", r6("vehicle_age_months").alias("vehicle_age_months"),
                                  r6("car_ready_age_months").alias("car_ready_age_months"))


def _cut_sql(c, edges, labels):
    whens = " ".join(f"WHEN {c}>{lo} AND {c}<={hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {whens} ELSE 'nan' END"


@query("age_buckets", f"""WITH {R.ENTITIES_SQL}, {AGES_SQL}
SELECT ent_id, {_cut_sql('va', K.AGE_EDGES, K.AGE_LABELS)} AS vehicle_age_category,
  {_cut_sql('ca', K.READY_EDGES, K.READY_LABELS)} AS car_ready_category FROM ages""")
def _(spark, sf):
    return K.age_buckets(aged(spark, sf)).select(
        "ent_id", "vehicle_age_category", "car_ready_category")


@query("recency_flags", f"""WITH {R.ENTITIES_SQL}, {AGES_SQL}
SELECT ent_id, CAST(ca<0 AND ca>-6 AS BIGINT) AS is_recent_av_fzg,
  CAST(va>0 AS BIGINT) AS is_new_vehicle FROM ages""")
def _(spark, sf):
    return K.recency_flags(aged(spark, sf)).select("ent_id", "is_recent_av_fzg", "is_new_vehicle")


DTD = f"coalesce({SQL_DAYS.format('rueckgabe_soll', AS_OF_SQL)},999)::DOUBLE"


@query("deadline_features", f"""WITH {R.ENTITIES_SQL}
SELECT ent_id, {DTD} AS days_to_deadline,
  CAST(rueckgabe_soll IS NOT NULL AS BIGINT) AS has_deadline FROM ent""")
def _(spark, sf):
    df = K.deadline_features(R.entities(spark, sf), R.AS_OF)
    return df.select("ent_id", "days_to_deadline", "has_deadline")


@query("category_cross", f"""WITH {R.ENTITIES_SQL}
SELECT ent_id, coalesce(derivat,'UNKNOWN')||'_'||basistyp AS derivat_x_basistyp,
  coalesce(hybrid,'UNKNOWN')||'_'||antriebsart AS hybrid_x_antrieb, prio||'_'||istufe AS prio_x_istufe,
  coalesce(derivat,'UNKNOWN')||'_'||pep_bauphase AS derivat_x_bauphase, prio||'_'||ksps AS prio_x_ksps
FROM ent""")
def _(spark, sf):
    return K.category_cross(R.entities(spark, sf)).select(
        "ent_id", "derivat_x_basistyp", "hybrid_x_antrieb", "prio_x_istufe",
        "derivat_x_bauphase", "prio_x_ksps")


@query("numeric_interactions", f"""WITH {R.ENTITIES_SQL}, {AGES_SQL},
f AS (SELECT *, CASE WHEN derivat IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY derivat) END AS fs FROM ages)
SELECT ent_id, round(va*fs,6)+0.0 AS age_x_fleet, round({DTD}*va,6)+0.0 AS deadline_x_age,
  round(coalesce(try_cast(prio AS DOUBLE),0)*fs,6) AS prio_x_fleet,
  CAST(rueckgabe_soll IS NOT NULL AND va>0 AS INTEGER)::DOUBLE AS deadline_x_new FROM f""")
def _(spark, sf):
    df = K.deadline_features(K.recency_flags(aged(spark, sf)), R.AS_OF)
    df = K.numeric_interactions(A.fleet_size(df, {"derivat": "derivat_fleet_size"}))
    return df.select("ent_id", *[r6(c).alias(c) for c in (
        "age_x_fleet", "deadline_x_age", "prio_x_fleet", "deadline_x_new")])


@query("select_features", f"""WITH {R.ENTITIES_SQL}
SELECT 'derivat_clean' AS feature, 'categorical' AS role, count(*) AS n FROM ent
UNION ALL SELECT 'bo_clean', 'categorical', count(*) FROM ent
UNION ALL SELECT 'c_acctbal', 'numeric', count(c_acctbal) FROM ent
UNION ALL SELECT 'days_to_deadline', 'numeric', count(*) FROM ent
UNION ALL SELECT 'has_deadline', 'numeric', count(*) FROM ent""")
def _(spark, sf):
    df = K.deadline_features(R.entities(spark, sf), R.AS_OF)
    df = K.clean_categoricals(df, ["derivat", "bo", "at_nummer"]).drop("ent_id")
    cat, num = K.select_features(df, C.LABEL)
    return FE.feature_inventory(df, cat, num)


@query("impute", f"""WITH {R.ENTITIES_SQL}, x AS (
  SELECT ent_id, hybrid, CASE WHEN ent_id%6=0 THEN NULL ELSE c_acctbal END AS bal,
    {SQL_DAYS.format('rueckgabe_soll', AS_OF_SQL)}::DOUBLE AS dtd FROM ent)
SELECT ent_id, coalesce(hybrid,'UNKNOWN') AS hybrid,
  round(coalesce(bal,(SELECT quantile_cont(bal,0.5) FROM x)),6) AS bal,
  round(coalesce(dtd,(SELECT quantile_cont(dtd,0.5) FROM x)),6) AS dtd FROM x""")
def _(spark, sf):
    from visitgrid.functions.core import floor_days, ts
    df = R.entities(spark, sf).select(
        "ent_id", "hybrid", F.when(F.col("ent_id") % 6 != 0, F.col("c_acctbal")).alias("bal"),
        floor_days("rueckgabe_soll", ts(R.AS_OF)).cast("double").alias("dtd"))
    out = FE.impute(df, ["hybrid"], ["bal", "dtd"])
    return out.select("ent_id", "hybrid", r6("bal").alias("bal"), r6("dtd").alias("dtd"))


_NF = ("CASE WHEN event_id%7=0 THEN 'nan'::DOUBLE WHEN event_id%7=1 THEN 'inf'::DOUBLE "
       "WHEN event_id%7=2 THEN NULL ELSE value END")


def _nonfinite(spark, sf):
    e = F.col("event_id") % 7
    v = (F.when(e == 0, F.lit(float("nan"))).when(e == 1, F.lit(float("inf")))
         .when(e != 2, F.col("value")))
    return R.table(spark, sf, "events").select("event_id", v.alias("v"))


@query("sanitize_nonfinite", f"""SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0 ELSE v END AS v
FROM (SELECT event_id, {_NF} AS v FROM events)""")
def _(spark, sf):
    return K.sanitize_nonfinite(_nonfinite(spark, sf), ["v"])


@query("nonfinite_counts", f"""SELECT 'v' AS feature, count(*) FILTER (v IS NULL OR isnan(v)) AS n_nan,
  count(*) FILTER (isinf(v)) AS n_inf FROM (SELECT {_NF} AS v FROM events)""")
def _(spark, sf):
    return K.nonfinite_counts(_nonfinite(spark, sf), ["v"])


_IX = ["l_quantity", "l_discount", "l_tax"]


@query("pairwise_interactions", """SELECT l_orderkey, l_linenumber, l_partkey,
  round(l_quantity*l_discount,6) AS "ix_l_quantity_l_discount", round(l_quantity*l_tax,6) AS "ix_l_quantity_l_tax"
FROM lineitem""")
def _(spark, sf):
    df = R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_IX)
    df = K.pairwise_interactions(df, _IX, max_pairs=2).drop(*_IX)
    return df.select(*[r6(c).alias(c) if c.startswith("ix_") else c for c in df.columns])


_TXT = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linenumber"]
_TXT_SQL = ("'l_quantity='||printf('%.4g',l_quantity)||'; l_discount='||printf('%.4g',l_discount)"
            "||'; l_tax='||CASE WHEN l_linenumber=3 THEN 'NA' ELSE printf('%.4g',l_tax) END"
            "||'; l_returnflag='||l_returnflag||'; l_linenumber='||l_linenumber")


def _text_rows(spark, sf):
    return R.table(spark, sf, "lineitem").withColumn(
        "l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_tax")))


@query("row_to_text", f"""SELECT l_orderkey, l_partkey, t AS text,
  '  '||replace(replace(t,'=',' = '),'; ',chr(10)||'  ') AS lines
FROM (SELECT l_orderkey, l_partkey, {_TXT_SQL} AS t FROM lineitem)""")
def _(spark, sf):
    df = _text_rows(spark, sf)
    return (df.select("l_orderkey", "l_partkey", X.row_to_text(df, _TXT).alias("text"))
            .withColumn("lines", X.text_to_lines(F.col("text"))))


_ROW_SQL = "'  l_quantity = '||printf('%.4g',l_quantity)||chr(10)||'  flag_clean = '||l_returnflag"


@query("prompt_table", f"""WITH cs AS (SELECT string_agg(s, chr(10) ORDER BY c) AS s FROM (SELECT l_linestatus AS c,
    l_linestatus||': '||count(*)||' rows, mean l_quantity '||CAST(CAST(round(avg(l_quantity),2) AS DECIMAL(18,2)) AS VARCHAR) AS s FROM lineitem GROUP BY 1)),
fs AS (SELECT string_agg(s, chr(10) ORDER BY c) AS s FROM (SELECT l_linestatus AS c, l_linestatus||':'||chr(10)||{_ROW_SQL} AS s
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag)=1))
SELECT l_orderkey, l_partkey, 'Name the line status.'||chr(10)||chr(10)||'[background]'||chr(10)||'Order lines of a trading company.'
  ||chr(10)||chr(10)||'[columns]'||chr(10)||'- l_quantity: a measured number'||chr(10)||'- flag_clean: one of several named values'
  ||chr(10)||chr(10)||'[classes seen so far]'||chr(10)||(SELECT s FROM cs)||chr(10)||chr(10)||'[one row of each class]'||chr(10)||(SELECT s FROM fs)
  ||chr(10)||chr(10)||'[this row]'||chr(10)||{_ROW_SQL}||chr(10)||chr(10)||'[answer]'||chr(10)||'A JSON object.' AS prompt FROM lineitem""")
def _(spark, sf):
    df = R.table(spark, sf, "lineitem").withColumn("flag_clean", F.col("l_returnflag"))
    cols = ["l_quantity", "flag_clean"]
    mean = F.round(F.avg("l_quantity"), 2).cast("decimal(18,2)").cast("string")
    line = F.concat("l_linestatus", F.lit(": "), F.count(F.lit(1)), F.lit(" rows, mean l_quantity "), mean)
    stats = df.groupBy("l_linestatus").agg(line.alias("s"))
    first = A.cap_per_class(df, "l_linestatus", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"], 1)
    shown = first.select("l_linestatus", F.concat("l_linestatus", F.lit(":\n"), X.row_to_lines(df, cols)).alias("s"))

    def lines(t):  # one line per class, in order
        rows = F.sort_array(F.collect_list(F.struct("l_linestatus", "s")))
        return t.agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n")).scalar()

    prompt = X.assemble_prompt("Name the line status.", [
        ("background", "Order lines of a trading company."),
        ("columns", X.feature_glossary([("l_quantity", "number"), ("flag_clean", "category")])),
        ("classes seen so far", lines(stats)), ("one row of each class", lines(shown)),
        ("this row", X.row_to_lines(df, cols)), ("answer", "A JSON object.")])
    return df.select("l_orderkey", "l_partkey", prompt.alias("prompt"))


def _answers(spark, sf):
    """Answer texts from the event properties: fenced, plain, out of range and broken JSON."""
    e = R.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    body = F.concat(F.lit('{"probability": '), (k / 50.0 - 0.2).cast("decimal(10,2)"),
                    F.lit(', "prediction": '), k % 2,
                    F.lit(', "explanation": "k is '), k, F.lit('"}'))
    i = F.col("event_id") % 5
    return e.select("event_id", k.alias("k"), F.when(i == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
                    .when(i == 1, F.lit("no json here")).otherwise(body).alias("answer"))


@query("parse_json_answer", """
SELECT event_id, CASE WHEN event_id%5=1 THEN 0.5 ELSE round(least(greatest(round(k/50.0-0.2,2),0),1),6) END::DOUBLE AS probability,
  CASE WHEN event_id%5=1 THEN 0 ELSE k%2 END AS prediction,
  CASE WHEN event_id%5=1 THEN '' ELSE 'k is '||k END AS explanation
FROM (SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)""")
def _(spark, sf):
    df = _answers(spark, sf)
    cols = X.parse_binary_answer(F.col("answer"))
    return df.select("event_id", r6(cols["probability"]).alias("probability"),
                     cols["prediction"].alias("prediction"), cols["explanation"].alias("explanation"))


@query("parse_class_answer", """
SELECT event_id, CASE WHEN event_id%4=0 OR k=0 THEN round(1.0/3,6) ELSE round(k/(k+1.0+(k%3)),6) END AS p_a,
  CASE WHEN event_id%4=0 OR k=0 THEN round(1.0/3,6) ELSE round((1.0+k%3)/(k+1.0+(k%3)),6) END AS p_b
FROM (SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)""")
def _(spark, sf):
    df = _answers(spark, sf)
    k = F.col("k")
    body = (F.when((F.col("event_id") % 4 == 0) | (k == 0), F.lit("{broken"))
            .otherwise(F.concat(F.lit('{"predictions": {"a": '), k, F.lit(', "b": '),
                                1 + k % 3, F.lit(', "zz": 4}}'))))
    df = df.select("event_id", X.parse_class_answer(body, ["a", "b", "c"]).alias("ps"))
    return df.select("event_id", r6(F.col("ps")[0]).alias("p_a"), r6(F.col("ps")[1]).alias("p_b"))


@query("parse_number_list", """
SELECT event_id, CASE WHEN event_id%4=3 AND event_id%8<>3 THEN NULL ELSE (k+0.5)::DOUBLE END AS v1,
  CASE WHEN event_id%4=3 AND event_id%8<>3 THEN NULL ELSE (k+1)::DOUBLE END AS v2,
  CASE WHEN event_id%4=3 AND event_id%8<>3 THEN NULL ELSE 7.0::DOUBLE END AS v3
FROM (SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)""")
def _(spark, sf):
    df = _answers(spark, sf)
    k, i = F.col("k"), F.col("event_id")
    nums = F.concat((k + 0.5).cast("decimal(10,1)"), F.lit(", "), k + 1, F.lit(", 7, 8"))
    text = (F.when(i % 4 == 0, F.concat(F.lit("["), nums, F.lit("]")))
            .when(i % 4 == 1, F.concat(F.lit("```\n["), nums, F.lit("]\n```")))
            .when(i % 4 == 2, F.concat(F.lit("Forecast: ["), nums, F.lit("] units")))
            .when(i % 8 == 3, F.concat(F.lit("values "), nums))
            .otherwise(F.lit("only 1 and 2")))
    out = X.parse_number_list(text, 3).alias("v")
    df = df.select("event_id", out)
    return df.select("event_id", *[F.get("v", F.lit(j)).alias(f"v{j + 1}") for j in range(3)])


@query("explode_package", f"""WITH {R.VISITS_SQL}
SELECT visit_id, trim(unnest(string_split(umr_art, ','))) AS type FROM vis WHERE umr_art IS NOT NULL""")
def _(spark, sf):
    return K.explode_package(R.visits(spark, sf)).select("visit_id", "type")
