"""Visit, entity and score tables derived from the given parquet tables.

Each role exists twice: as a DataFrame, and as the SQL text of the same derivation
(``*_SQL``, common table expressions) for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitgrid.functions.core import md5_int

AS_OF = "2001-08-02 00:00:00"
LABEL_FROM = "2001-03-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A parquet table with zone-less timestamps read as UTC timestamps."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*[
        F.col(f.name).cast("timestamp").alias(f.name)
        if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name)
        for f in df.schema.fields])


def _keys(c: str):
    k = F.col(c)
    return [
        F.concat(F.lit("V"), k).alias("v_nummer"),
        F.when(k % 7 == 0, F.lit("0")).otherwise(F.concat(F.lit("B"), k)).alias("bt_nummer"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("A"), k)).alias("at_nummer"),
    ]


def _as_of_plus(days) -> F.Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF)) + days * 86400)


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Master data: one row per customer with the optional attribute columns."""
    k = F.col("c_custkey")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    df = (table(spark, sf, "customer")
          .join(nation, F.col("c_nationkey") == nation.n_nationkey)
          .join(region, F.col("n_regionkey") == region.r_regionkey))
    return df.select(
        k.alias("ent_id"), *_keys("c_custkey"),
        F.when(k % 17 != 0, F.col("c_mktsegment")).alias("derivat"),
        F.col("n_name").alias("bo"), F.col("r_name").alias("puk_werk"),
        F.when(k % 19 == 0, F.lit("x")).otherwise((k % 3 + 1).cast("string")).alias("prio"),
        _as_of_plus(k * 37 % 1500 - 700).alias("sop"),
        F.when(k % 11 != 0, _as_of_plus(k * 53 % 900 - 400)).alias("rueckgabe_soll"),
        F.when(k % 13 != 0, _as_of_plus(k * 29 % 1100 - 300)).alias("av_fzg"),
        F.concat(F.lit("T"), k % 4).alias("basistyp"),
        F.when(k % 3 != 0, F.concat(F.lit("H"), k % 2)).alias("hybrid"),
        F.concat(F.lit("D"), k % 2).alias("antriebsart"),
        F.concat(F.lit("I"), k % 6).alias("istufe"),
        F.concat(F.lit("P"), k % 3).alias("pep_bauphase"),
        F.concat(F.lit("K"), k % 2).alias("ksps"),
        F.when(k % 23 != 0, F.concat(F.lit("M"), k % 8)).alias("motortyp"),
        F.concat(F.lit("L"), k % 5).alias("pl"),
        F.col("c_acctbal"))


ENTITIES_SQL = """
ent AS (
  SELECT c_custkey AS ent_id, 'V'||c_custkey AS v_nummer,
    CASE WHEN c_custkey%7=0 THEN '0' ELSE 'B'||c_custkey END AS bt_nummer,
    CASE WHEN c_custkey%5=0 THEN '' ELSE 'A'||c_custkey END AS at_nummer,
    CASE WHEN c_custkey%17<>0 THEN c_mktsegment END AS derivat,
    n_name AS bo, r_name AS puk_werk,
    CASE WHEN c_custkey%19=0 THEN 'x' ELSE CAST(c_custkey%3+1 AS VARCHAR) END AS prio,
    TIMESTAMP '2001-08-02 00:00:00' + to_days(CAST(c_custkey*37%1500-700 AS INTEGER)) AS sop,
    CASE WHEN c_custkey%11<>0 THEN TIMESTAMP '2001-08-02 00:00:00'
      + to_days(CAST(c_custkey*53%900-400 AS INTEGER)) END AS rueckgabe_soll,
    CASE WHEN c_custkey%13<>0 THEN TIMESTAMP '2001-08-02 00:00:00'
      + to_days(CAST(c_custkey*29%1100-300 AS INTEGER)) END AS av_fzg,
    'T'||c_custkey%4 AS basistyp,
    CASE WHEN c_custkey%3<>0 THEN 'H'||c_custkey%2 END AS hybrid,
    'D'||c_custkey%2 AS antriebsart, 'I'||c_custkey%6 AS istufe,
    'P'||c_custkey%3 AS pep_bauphase, 'K'||c_custkey%2 AS ksps,
    CASE WHEN c_custkey%23<>0 THEN 'M'||c_custkey%8 END AS motortyp,
    'L'||c_custkey%5 AS pl, c_acctbal
  FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)
"""


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Raw visits: one row per order; the package is the descending list of return flags."""
    li = (table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_set("l_returnflag"), asc=False), ",").alias("umr_art"),
        F.min("l_shipdate").alias("umr_av")))
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "P", F.lit("Cancelled"))
              .when(F.col("o_orderstatus") == "F", F.lit("Completed"))
              .when((F.col("o_orderstatus") == "O") & (k % 10 != 0), F.lit("Planned")))
    return o.join(li, k == F.col("l_orderkey"), "left").select(
        k.alias("visit_id"), *_keys("o_custkey"),
        F.col("o_orderdate").alias("umr_start"), "umr_av", status.alias("umr_status"), "umr_art",
        F.col("o_totalprice").alias("cost"), F.col("o_orderpriority").alias("priority"))


VISITS_SQL = """
li AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag DESC) AS umr_art,
         min(l_shipdate) AS umr_av FROM lineitem GROUP BY l_orderkey),
vis AS (
  SELECT o_orderkey AS visit_id, 'V'||o_custkey AS v_nummer,
    CASE WHEN o_custkey%7=0 THEN '0' ELSE 'B'||o_custkey END AS bt_nummer,
    CASE WHEN o_custkey%5=0 THEN '' ELSE 'A'||o_custkey END AS at_nummer,
    o_orderdate AS umr_start, umr_av,
    CASE WHEN o_orderstatus='P' THEN 'Cancelled' WHEN o_orderstatus='F' THEN 'Completed'
         WHEN o_orderstatus='O' AND o_orderkey%10<>0 THEN 'Planned' END AS umr_status,
    umr_art, o_totalprice AS cost, o_orderpriority AS priority
  FROM orders LEFT JOIN li ON o_orderkey=l_orderkey)
"""


def sql_key(*chain: str) -> str:
    """The SQL of a key chain (missing tokens count as null)."""
    return "COALESCE(" + ",".join(
        f"CASE WHEN {c} IN ('nan','','0','0.0') THEN NULL ELSE {c} END" for c in chain) + ")"


SQL_KEY = sql_key("at_nummer", "bt_nummer", "v_nummer")
SQL_PACKAGE = ("array_to_string(list_sort(list_transform(string_split(umr_art, ','),"
               " lambda x: trim(x))), ', ')")

# Cleaned visits: status filter, normalised package, blanks dropped, join key.
CLEAN_SQL = VISITS_SQL + f""",
cl AS (
  SELECT DISTINCT visit_id, v_nummer, bt_nummer, at_nummer, umr_start, umr_av, umr_status,
    {SQL_PACKAGE} AS umr_art, cost, priority, {SQL_KEY} AS jk
  FROM vis WHERE umr_status IS DISTINCT FROM 'Cancelled' AND umr_art IS NOT NULL
    AND trim(umr_art) <> '')
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Binary labels with a noisy score (many ties): id, y, p, and a second score p2."""
    m = md5_int("o_orderkey") % 10000 / F.lit(10000.0)
    m2 = md5_int(F.concat(F.col("o_orderkey"), F.lit("b"))) % 10000
    y = (F.col("o_orderstatus") == "F").cast("long")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), y.alias("y"),
        F.round((m + 0.35 * y) / 1.35, 3).alias("p"),
        (F.floor((m2 + 2000 * y) / 12) / 1000.0).alias("p2"))


MD5 = "CAST('0x'||substr(md5(CAST({} AS VARCHAR)),1,8) AS BIGINT)"
SCORED_SQL = f"""
sc AS (
  SELECT id, y, round((m+0.35*y)/1.35,3) AS p, ((m2+2000*y)//12)/1000.0::DOUBLE AS p2 FROM (
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus='F' THEN 1::BIGINT ELSE 0 END AS y,
      {MD5.format('o_orderkey')}%10000/10000.0::DOUBLE AS m,
      {MD5.format("o_orderkey||'b'")}%10000 AS m2 FROM orders))
"""

# The packages that return flags can form.
PACKAGES = ["A", "A, N", "A, N, R", "A, R", "N", "N, R", "R"]


def class_probs(spark: SparkSession, sf: str) -> DataFrame:
    """Class probabilities per entity over all packages (weights from md5, normalised).

    The keys are dealt out first: a table of few files would be weighted in as few tasks. Each weight is
    taken once, in a projection of its own below those that read it.
    """
    k = F.col("c_custkey")
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    weights = [md5_int(F.concat(k, F.lit("-" + c))) % 1000 + 1 for c in PACKAGES]
    keys = table(spark, sf, "customer").select(k).repartition(n, k)
    each = keys.select(k.alias("ent_id"), F.array(*weights).alias("w"))
    each = each.withColumn("total", sum((F.get("w", F.lit(i)) for i in range(len(PACKAGES))), F.lit(0)))
    pairs = F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(i).cast("long").alias("code"),
                               (F.get("w", F.lit(i)) / F.col("total")).alias("p")) for i, c in enumerate(PACKAGES)])
    return each.select("ent_id", F.explode(pairs).alias("s")).select("ent_id", "s.cls", "s.code", "s.p")


PROBS_SQL = f"""
cpw AS (SELECT c_custkey AS ent_id, cls, code, {MD5.format("c_custkey||'-'||cls")}%1000+1 AS w
  FROM customer, (SELECT unnest({PACKAGES}) AS cls, unnest(range(7)) AS code)),
cp AS (SELECT ent_id, cls, code, w::DOUBLE/sum(w) OVER (PARTITION BY ent_id)::DOUBLE AS p FROM cpw)
"""


def durations(spark: SparkSession, sf: str) -> DataFrame:
    """Actual and predicted durations in days with a type: from line items."""
    days = F.pmod(md5_int(F.concat("l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"),
                                   "l_partkey")), F.lit(60)).cast("double")
    y = F.round(F.col("l_quantity") * 0.8 + days * 0.3, 2)
    yhat = F.round(F.col("l_quantity") * 0.7 + F.lit(10.0) + F.col("l_discount") * 20, 2)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("type"),
        F.col("l_partkey").alias("part"),
        F.when(md5_int("l_orderkey") % 100 < 20, F.lit("test")).otherwise(F.lit("train"))
        .alias("split"), y.alias("y"), yhat.alias("yhat"),
        F.round(F.col("l_tax") * 300 + days * 0.2, 2).alias("yhat2"))


DURATIONS_SQL = f"""
du AS (SELECT l_orderkey AS id, l_returnflag||'/'||l_linestatus AS type, l_partkey AS part,
  CASE WHEN {MD5.format('l_orderkey')}%100<20 THEN 'test' ELSE 'train' END AS split,
  round(l_quantity*0.8+d*0.3,2) AS y, round(l_quantity*0.7+10.0+l_discount*20,2) AS yhat,
  round(l_tax*300+d*0.2,2) AS yhat2
  FROM (SELECT *, ({MD5.format("l_orderkey||'-'||l_linenumber||'-'||l_partkey")}%60)::DOUBLE AS d
        FROM lineitem))
"""


def wide_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Packages over part types per order (many rare combinations), with an id."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_orderkey").alias("id"))
            .agg(F.array_join(F.sort_array(F.collect_set("p_type")), ", ").alias("cls")))


WIDE_SQL = """
wp AS (SELECT l_orderkey AS id, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS cls
  FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1)
"""


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly count and mean of the whole-unit order price per priority."""
    return (table(spark, sf, "orders")
            .groupBy(F.col("o_orderpriority").alias("series_id"),
                     F.date_trunc("month", "o_orderdate").alias("month"))
            .agg(F.count(F.lit(1)).alias("n"),
                 (F.sum(F.floor("o_totalprice")) / F.count(F.lit(1))).alias("y")))


MONTHLY_SQL = """
mo AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::TIMESTAMP AS month,
  count(*) AS n, sum(floor(o_totalprice))/count(*) AS y FROM orders GROUP BY 1,2)
"""
