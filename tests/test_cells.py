"""Tree models on cells: no row is left out, and a cell's sums are its rows' sums."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from visitgrid.operators import cells as CL
from visitgrid.operators import forest as FO
from visitgrid.operators import models as M
from visitgrid.sources.reuse import ResultStore

N = 24_000


def u(k, n=1000):
    return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)) / n


@pytest.fixture(scope="module")
def table(spark):
    """More rows than a fit read before (20,000), one feature with gaps."""
    return spark.range(N).select("id", u(1).alias("a"), F.when(F.col("id") % 50 > 0, u(2)).alias("b"), F.floor(u(3) * 12).alias("c")).withColumns({
        "y": ((F.col("a") + 0.3 * u(2) > 0.7).cast("int") + (F.col("a") > 0.9).cast("int")), "v": F.round(F.col("a") * 4 + F.col("c"), 1)}).cache()


@pytest.fixture
def seen(monkeypatch):
    """Rows that each fit counted into cells."""
    found, cells_of = [], CL.cells_of

    def watched(*args):
        cells = cells_of(*args)
        found.append(cells.agg(F.sum("n")).first()[0])
        return cells

    monkeypatch.setattr(CL, "cells_of", watched)
    return found


def test_fits_read_all_rows(table, seen):
    assert M.fit_table(table, ["id", "a", "y"]).count() == N and M.fit_input(table, ["a", "y"], N).count() == N
    M.fit_classifier(table, ["a", "c"], "y", "rf")
    M.fit_regressor(table, ["a", "c"], "v", "rf")
    M.fit_regressor(table, ["a", "c"], "v", "gbt")
    assert seen == [N, N, N]


def test_cuts(spark, table):
    few, many = CL.cuts_of(table, ["c", "a"])
    assert few == list(range(1, 12)) and len(many) == CL.BINS - 1
    a = np.sort([r["a"] for r in table.select("a").collect()])
    share = np.diff(np.searchsorted(a, [-1, *many, 2])) / N * CL.BINS
    assert share.min() > 0.85 and share.max() < 1.15 and set(many) <= set(a)
    odd = spark.createDataFrame([(float("nan"), None, 0.0), (1.0, None, -0.0), (float("inf"), None, 2.0), (None, None, 2.0)], "x double, none double, z double")
    assert CL.cuts_of(odd, ["z"]) == [[2.0]]
    # fits ask for finite numbers, as Spark ML's do; scoring takes every row
    for f in ("x", "none"):
        with pytest.raises(ValueError, match=f):
            CL.cuts_of(odd, ["z", f])
    cells = CL.binned(odd, ["x", "none", "z"], [[0.5], [], [2.0]]).toPandas()["__cell_0"].to_numpy()
    assert sorted(map(tuple, CL.unpacked([cells], 3).tolist())) == [(1, 0, 0), (1, 0, 0), (1, 0, 1), (1, 0, 1)]


def test_forest_on_cells(spark, table, tmp_path):
    x = ["a", "b", "c"]
    whole, table = table.fillna(0.0, ["b"]), table.withColumn("b", F.coalesce("b", F.lit(float("nan"))))
    model = M.fit_classifier(whole, x, "y", "rf")
    assert isinstance(model, CL.CellForest) and model.trees.count() == M.TREES
    rows = model.transform(table).select("id", "y", "probability", "prediction").orderBy("id").collect()
    assert len(rows) == N and sum(r["y"] == r["prediction"] for r in rows) > 0.93 * N
    # the votes of the trees, row by row
    cells = CL.binned(table, x, model.cuts).orderBy("id").select("__cell_0").toPandas()["__cell_0"].to_numpy()
    bins, votes, w = CL.unpacked([cells], 3), 0, np.array(model.weights)
    for t in model.trees.collect():
        tree = CL.Tree.unpacked(bytes(t["data"]))
        leaf = (tree.leaves * w)[tree.leaf_of(bins)]
        votes = votes + leaf / leaf.sum(1, keepdims=True) / M.TREES
    assert np.allclose(votes, [r["probability"].toArray() for r in rows])
    imp = model.stages[-1].featureImportances
    assert sum(imp) == pytest.approx(1) and imp[0] > imp[1] > 0
    # balanced weights: n / (classes * rows of the class)
    assert model.weights == pytest.approx([r["weight"] for r in M.class_weights(whole, "y").orderBy("y").collect()])
    store = ResultStore(spark, str(tmp_path), table)
    store.model("m", lambda: model)
    again = store.model("m", lambda: pytest.fail("fitted twice"))
    assert [r["probability"] for r in again.transform(table).orderBy("id").collect()] == [r["probability"] for r in rows]
    twice = M.fit_classifier(whole.repartition(5), x, "y", "rf")
    assert sorted(bytes(t["data"]) for t in twice.trees.collect()) == sorted(bytes(t["data"]) for t in model.trees.collect())


def test_as_good_as_in_parts(table, monkeypatch):
    train, test = table.where("id % 4 > 0"), table.where("id % 4 = 0")

    def error():
        m = M.fit_regressor(train, ["a", "c"], "v", "rf")
        return M.predicted(m, test).agg(F.avg(F.abs(F.col("prediction") - F.col("v")))).first()[0]

    monkeypatch.setattr(FO, "ALL_CELL_ROWS", 2000)
    on_cells = error()
    monkeypatch.setattr(FO, "ALL_CELL_ROWS", 10 ** 9)
    assert on_cells < 1.2 * error() + 0.02


def test_splits_by_brute_force():
    """The best split of every node, against all splits of its rows one by one."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (200, 3)).astype(np.uint8)
    for weights in (np.array([1.0, 2.5]), None):
        stat = rng.integers(0, 4, (200, 2)).astype(np.int32) if weights is not None else np.stack([n := rng.integers(1, 4, 200).astype(float), y := n * rng.random(200), y * y / n], 1)
        own = np.sort(rng.integers(0, 5, 200)).astype(np.int32)
        total = np.stack([stat[own == k].sum(0) for k in range(5)])
        sub = np.array([[0, 1], [1, 2], [2, 0], [0, 2], [1, 0]])
        gain, feature, cut, left = CL.best_splits(x, stat, own, total, sub, weights, 3)
        for k in range(5):
            found = []
            for f in sub[k]:
                for b in range(5):
                    part = stat[(own == k) & (x[:, f] <= b)].sum(0)[None]
                    rest = total[k][None] - part
                    (ln, lw, li), (rn, rw, ri) = CL.impurity(part, weights), CL.impurity(rest, weights)
                    if min(ln[0], rn[0]) >= 3:
                        found.append(CL.impurity(total[k][None], weights)[2][0] - (lw * li + rw * ri)[0] / (lw + rw)[0])
            assert gain[k] == pytest.approx(max(found))
            assert left[k] == pytest.approx(stat[(own == k) & (x[:, feature[k]] <= cut[k])].sum(0))


def test_boosted_trees_on_cells_equal_those_on_rows(table):
    """Where every value is a bin, counted cells and rows give one model."""
    whole = table.withColumn("d", F.floor(F.col("a") * 30)).withColumn("y", (F.col("y") > 0).cast("int"))
    one = M.positive_score(M.fit_classifier(whole, ["c", "d"], "y", "gbt"), whole, "p").select("id", "p")
    train = M.with_class_weight(whole, "y")
    rows = Pipeline(stages=[M._assembler(["c", "d"]), M.classifier("gbt", "y", "__w")]).fit(train)
    two = M.positive_score(rows, whole, "q").select("id", "q")
    assert one.join(two, "id").where("abs(p - q) > 1e-6").count() == 0


def test_leaf_quantiles_on_cells(table):
    """As the quantiles of the train rows themselves, leaf by leaf."""
    train, new = table.where("id % 5 > 0"), table.where("id % 5 = 0")
    q = M.quantile_forest(train, new, "id", ["c"], "v", {"p50": 0.5, "p90": 0.9}, numTrees=1, minInstancesPerNode=1)
    want = {r["c"]: r for r in train.groupBy("c").agg(F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.9).alias("p90")).collect()}
    got = q.select("c", "p50", "p90").distinct().collect()
    assert q.count() == new.count() and len(got) == 12
    assert all(r[p] == pytest.approx(want[r["c"]][p]) for r in got for p in ("p50", "p90"))
