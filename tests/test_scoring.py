"""The scoring stages over small tables of their own: how the work is dealt out, and what it gives."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from visitgrid.catalog import scoring
from visitgrid.catalog.registry import QUERIES
from visitgrid.catalog.stages import Stages
from visitgrid.plans import roles as R


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("world"))
    day = dt.datetime(2001, 3, 1)
    tables = {
        "region": ([(0, "EUROPE")], "r_regionkey long, r_name string"),
        "nation": ([(0, "GERMANY", 0), (1, "FRANCE", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(k, k % 2, f"SEG{k % 3}", float(k)) for k in range(1, 301)],
                     "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double"),
        "orders": ([(k, k % 200 + 1, "FOP"[k % 3], day + dt.timedelta(days=k % 400), 10.0 * k, "1-URGENT") for k in range(1, 601)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_totalprice double, o_orderpriority string"),
        "lineitem": ([(k, "ANR"[(k + i) % 3], day + dt.timedelta(days=k % 400 + i)) for k in range(1, 601) for i in range(k % 3 + 1)],
                     "l_orderkey long, l_returnflag string, l_shipdate timestamp")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def test_class_probs_are_dealt_out(spark, world):
    """Weights of every class as by hand; the keys of one file are weighted in more than one task."""
    got = R.class_probs(spark, world)
    rows = {(r["ent_id"], r["cls"]): (r["code"], r["p"]) for r in got.collect()}
    assert len(rows) == got.count() == 300 * len(R.PACKAGES)
    for k in (1, 17, 300):
        w = [int(hashlib.md5(f"{k}-{c}".encode()).hexdigest()[:8], 16) % 1000 + 1 for c in R.PACKAGES]
        assert [rows[k, c] for c in R.PACKAGES] == [(i, x / sum(w)) for i, x in enumerate(w)]
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_classes_are_not_broadcast(spark, world):
    """Seven rows per entity are joined by shuffle: the size of the keys' file does not tell their size."""
    plan = scoring._ranked(Stages(spark, world))._jdf.queryExecution().executedPlan().toString()
    top = next(x for x in plan.splitlines() if "Join" in x)
    assert "SortMergeJoin" in top and "ent_id" in top


def test_visits_are_built_once(spark, world, monkeypatch):
    """The export reads raw and cleaned visits, and groups the line items once; the forecast's visits are ranked once."""
    built, ranked = [], []
    visits, top = R.visits, scoring.top_visits
    monkeypatch.setattr(R, "visits", lambda *a: built.append(1) or visits(*a))
    monkeypatch.setattr(scoring, "top_visits", lambda st: ranked.append(1) or top(st))
    rows = QUERIES["export_table"](spark, world).collect()
    assert rows and len(built) == 1 and len(ranked) == 1
    assert sum(r["umr_status"] != "Forecast" for r in rows) == 600
