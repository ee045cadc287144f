from pyspark.sql import functions as F

from visitgrid.operators import aggregates as A
from visitgrid.plans import ordered as O
from visitgrid.sources import csv as CSV
from visitgrid.sources.reuse import ResultStore, table_fingerprint


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 1, None), ("c", 2, "x")], "umr_art string, n int, umr_status string")
    CSV.write_csv(df, str(tmp_path / "o"))
    back = CSV.read_csv(spark, str(tmp_path / "o"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_renames(spark, tmp_path):
    df = spark.createDataFrame([("1", "2020-01-01")], "VNumber string, Anlauf_SOP_AT string")
    CSV.write_csv(df, str(tmp_path / "e"))
    assert CSV.read_entities(spark, str(tmp_path / "e")).columns == ["v_nummer", "sop"]


def test_fingerprint_ignores_row_order(spark):
    a = spark.range(100).select("id", (F.col("id") % 7).alias("x"))
    fa = table_fingerprint(a).first()["fingerprint"]
    assert fa == table_fingerprint(a.orderBy(F.desc("id")).repartition(3)).first()["fingerprint"]
    assert fa != table_fingerprint(a.where("id < 99")).first()["fingerprint"]
    assert fa != table_fingerprint(a.withColumnRenamed("x", "y")).first()["fingerprint"]


def test_store_rebuilds_only_for_new_data(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    a = spark.range(10)
    for src, n in ((a, 1), (a, 1), (spark.range(11), 2)):
        assert ResultStore(spark, str(tmp_path), src).table("t", build).count() == 3
        assert len(calls) == n


def test_store_rebuilds_damaged_tables_only(spark, tmp_path):
    a = spark.range(10)
    store = ResultStore(spark, str(tmp_path), a)
    first = store.table("t", lambda: spark.range(5).repartition(3))
    files = first.inputFiles()
    assert store.table("t", lambda: 1 / 0).count() == 5
    with open(files[0].removeprefix("file:"), "wb") as f:
        f.write(b"no parquet at all")
    for crc in tmp_path.rglob(".*.crc"):
        crc.write_bytes(b"")
    assert store.table("t", lambda: spark.range(7)).count() == 7
    newer = ResultStore(spark, str(tmp_path), spark.range(11))
    newer.table("t", lambda: spark.range(1))
    assert newer.drop_others() == 1 and newer.table("t", lambda: 1 / 0).count() == 1


def test_checkpoint_dir_is_needed_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    try:
        O.checkpoint_dir(Session())
    except ValueError:
        return
    raise AssertionError("a machine-local folder was taken on a cluster")


def test_checkpoint_dir_comes_from_the_session(spark, tmp_path, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": f"{tmp_path}/shared/"}.get(key, default)

    class Session:
        conf = Conf()

    shared = O.checkpoint_dir(Session())
    assert shared == f"{tmp_path}/shared"
    monkeypatch.setattr(O, "checkpoint_dir", lambda _: shared)
    df = O.materialize(spark.range(5))
    assert df.count() == 5 and f"{tmp_path}/shared" in df.inputFiles()[0]


def test_group_sizes_null_key(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "c string")
    got = sorted((str(r["c"]), r["n"]) for r in A.with_group_size(df, ["c"], "n").collect())
    assert got == [("None", 0), ("a", 2), ("a", 2), ("b", 1)]
    flags = {r["c"]: r["f"] for r in A.common_flag(df, "c", "f").collect()}
    assert flags == {"a": 1, "b": 0, None: 0}
