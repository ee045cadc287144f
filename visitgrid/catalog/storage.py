"""CSV, fingerprint, reuse and validation queries."""

import uuid

from pyspark.sql import functions as F

from visitgrid.catalog.cleansing import day
from visitgrid.catalog.registry import query
from visitgrid.functions.core import r6
from visitgrid.operators import aggregates as A
from visitgrid.plans import roles as R
from visitgrid.plans.ordered import checkpoint_dir
from visitgrid.sources import csv as CSV
from visitgrid.sources.reuse import ResultStore, table_fingerprint
from visitgrid.sources.validate import validate_table


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_csv_rename", f"""WITH {R.VISITS_SQL} SELECT visit_id, v_nummer, strftime(umr_start,'%Y-%m-%d') AS umr_start, umr_status, umr_art FROM vis""")
def _(spark, sf):
    path = _scratch(spark, "visits")
    raw = R.visits(spark, sf).select("visit_id", "v_nummer", F.col("umr_start").alias("start_ur"),
                                     F.col("umr_status").alias("umruststatus"), F.col("umr_art").alias("umruestart"))
    CSV.write_csv(raw, path)
    df = CSV.read_visits(spark, path, "visit_id long, v_nummer string, start_ur timestamp, umruststatus string, umruestart string")
    return df.withColumn("umr_start", day("umr_start"))


@query("scan_csv_lower_rename", f"""WITH {R.ENTITIES_SQL} SELECT v_nummer, bt_nummer, CASE WHEN at_nummer='' THEN NULL ELSE at_nummer END AS at_nummer,
  strftime(sop,'%Y-%m-%d') AS sop, prio FROM ent""")
def _(spark, sf):
    path = _scratch(spark, "entities")
    raw = R.entities(spark, sf).select(F.col("v_nummer").alias("VNumber"), F.col("bt_nummer").alias("BTNumber"),
                                       F.col("at_nummer").alias("AT_ID"), F.col("sop").alias("Anlauf_SOP_AT"),
                                       F.col("prio").alias("Prio_Int"))
    CSV.write_csv(raw, path)
    df = CSV.read_entities(spark, path, "VNumber string, BTNumber string, AT_ID string, Anlauf_SOP_AT timestamp, Prio_Int string")
    # an empty text field and a missing one are the same in CSV
    return df.withColumns({"sop": day("sop"), "at_nummer": F.nullif("at_nummer", F.lit(""))})


@query("downcast_numeric", "SELECT l_orderkey::INTEGER AS l_orderkey, l_linenumber, round(l_quantity::FLOAT::DOUBLE,3) AS l_quantity, round(l_tax::FLOAT::DOUBLE,3) AS l_tax FROM lineitem")
def _(spark, sf):
    df = CSV.downcast_numeric(R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"))
    return df.withColumns({c: F.round(F.col(c).cast("double"), 3) for c in ("l_quantity", "l_tax")})


@query("sink_csv_export", "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1")
def _(spark, sf):
    path = _scratch(spark, "export")
    o = R.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    CSV.write_csv(o, path)
    back = CSV.read_csv(spark, path, "priority string, price double")
    return back.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("table_fingerprint", "SELECT count(*) AS n_rows, 6 AS n_cols, 16 AS digits, 1 AS order_free FROM orders")
def _(spark, sf):
    """Rows, columns and digits, and whether the fingerprint stays the same in another row order."""
    o = R.table(spark, sf, "orders")
    other = table_fingerprint(o.orderBy(F.desc("o_totalprice"), "o_orderkey")).select("fingerprint").scalar()
    df = table_fingerprint(o)
    return df.select("n_rows", "n_cols", F.length("fingerprint").alias("digits"), (F.col("fingerprint") == other).cast("int").alias("order_free"))


@query("checkpoint_reuse", "SELECT strftime(date_trunc('month',o_orderdate),'%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    o = R.table(spark, sf, "orders")
    store = ResultStore(spark, _scratch(spark, "store"), o)
    store.table("monthly", lambda: A.monthly_volume(o, "o_orderdate"))
    again = store.table("monthly", lambda: o.limit(0))  # found, so not rebuilt
    return again.select(day("month", "yyyy-MM").alias("month"), "n")


@query("validate_table", f"""WITH {R.ENTITIES_SQL}, p AS (SELECT * FROM ent WHERE sop<TIMESTAMP '{R.AS_OF}'), m AS (SELECT avg(c_acctbal) AS a, avg(ent_id) AS b FROM ent),
q AS (SELECT avg(c_acctbal) AS a, avg(ent_id) AS b FROM p)
SELECT 'min_rows' AS "check", 'table' AS subject, count(*)::DOUBLE AS value, CAST(count(*)>=50 AS BIGINT) AS ok FROM ent
UNION ALL SELECT 'duplicates', 'table', 0.0, 1
UNION ALL SELECT 'required', 'v_nummer', 1.0, 1 UNION ALL SELECT 'required', 'absent', 0.0, 0
UNION ALL SELECT 'null_ratio', c, round(v,6), CAST(v<=0.2 AS BIGINT) FROM (SELECT unnest(['ent_id','v_nummer','hybrid','derivat','c_acctbal']) AS c,
  unnest([0.0, 0.0, avg((hybrid IS NULL)::INT), avg((derivat IS NULL)::INT), 0.0]) AS v FROM ent)
UNION ALL SELECT 'mean_drift', 'ent_id', round(abs(m.b-q.b)/abs(q.b),6), CAST(abs(m.b-q.b)/abs(q.b)<=0.1 AS BIGINT) FROM m, q
UNION ALL SELECT 'mean_drift', 'c_acctbal', round(abs(m.a-q.a)/abs(q.a),6), CAST(abs(m.a-q.a)/abs(q.a)<=0.1 AS BIGINT) FROM m, q""")
def _(spark, sf):
    cols = ["ent_id", "v_nummer", "hybrid", "derivat", "c_acctbal"]
    e = R.entities(spark, sf)
    before = e.where(F.col("sop") < F.lit(R.AS_OF).cast("timestamp")).select(*cols)
    df = validate_table(e.select(*cols), ["v_nummer", "absent"], before)
    return df.withColumn("value", r6("value"))
