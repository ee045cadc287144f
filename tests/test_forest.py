"""Forests in parts: bounded per part, as good as whole ones, stored and loaded."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from visitgrid.operators import forest as FO
from visitgrid.operators import models as M
from visitgrid.sources.reuse import ResultStore


@pytest.fixture(scope="module")
def table(spark):
    def u(k):
        return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000
    return spark.range(1500).select("id", u(1).alias("a"), u(2).alias("b")).withColumns({
        "y": (F.col("a") + 0.3 * F.col("b") > 0.7).cast("int") + (F.col("a") > 0.9).cast("int"), "v": F.col("a") * F.col("b")}).cache()


def test_part_trees():
    assert FO.part_trees(300, 1000, 20, 2) == [300] and FO.part_trees(5, 0, 3, 1) == [5]
    sizes = FO.part_trees(300, 20_000, 20, 2)
    assert sum(sizes) == 300 and max(sizes) - min(sizes) <= 1 and max(sizes) * 12_600 <= FO.PART_NODES * 1.1
    assert FO.part_trees(2, 10 ** 9, 30, 1) == [1, 1]


def test_parts_vote_like_one_forest(spark, table, monkeypatch, tmp_path):
    whole = M.fit_classifier(table, ["a", "b"], "y", "rf")
    assert isinstance(whole, PipelineModel)
    monkeypatch.setattr(FO, "PART_NODES", 400)
    model = M.fit_classifier(table, ["a", "b"], "y", "rf")
    nodes = [PipelineModel.load(f).stages[-1].totalNumNodes for f, _ in model.parts]
    assert len(nodes) > 2 and model.trees == M.TREES and max(nodes) < 3 * 400
    rows = model.transform(table).select("id", "y", "probability", "prediction").collect()
    assert len(rows) == 1500 and sum(r["y"] == r["prediction"] for r in rows) > 1400
    # the mean vote of all trees, part by part
    votes = {}
    for folder, _ in model.parts:
        for r in PipelineModel.load(folder).transform(table).select("id", "rawPrediction").collect():
            votes[r["id"]] = votes.get(r["id"], 0) + r["rawPrediction"].toArray()
    for r in rows:
        assert r["probability"].toArray() == pytest.approx(votes[r["id"]] / M.TREES)
        assert r["prediction"] == r["probability"].toArray().argmax()
    assert sum(model.stages[-1].featureImportances) == pytest.approx(1)
    store = ResultStore(spark, str(tmp_path), table)
    store.model("m", lambda: model)
    again = store.model("m", lambda: pytest.fail("fitted twice"))
    assert again.parts != model.parts and [n for _, n in again.parts] == [n for _, n in model.parts]
    assert M.predicted(again, table).where("prediction <> y").count() == sum(r["y"] != r["prediction"] for r in rows)


def test_parts_average_like_one_forest(table, monkeypatch):
    monkeypatch.setattr(FO, "PART_NODES", 400)
    model = M.fit_regressor(table, ["a", "b"], "v", "rf")
    assert len(model.parts) > 2
    sums = {}
    for folder, n in model.parts:
        for r in PipelineModel.load(folder).transform(table).select("id", "prediction").collect():
            sums[r["id"]] = sums.get(r["id"], 0) + n * r["prediction"]
    for r in M.predicted(model, table).collect():
        assert r["prediction"] == pytest.approx(sums[r["id"]] / M.TREES) and abs(r["prediction"] - r["v"]) < 0.2


def test_stack_of_a_forest_in_parts(spark, table, monkeypatch):
    """The vectors of a forest in parts go through an assembler, and one part is scored at a time."""
    monkeypatch.setattr(FO, "PART_NODES", 400)
    active, most, whole = [], [], FO.materialize

    def watched(df):
        if "__sum" not in df.columns:
            return whole(df)
        active.append(1)
        most.append(len(active))
        try:
            return whole(df)
        finally:
            active.pop()

    monkeypatch.setattr(FO, "materialize", watched)
    bases, meta = M.stack_classes(table, "id", ["a", "b"], "y", ["logreg", "rf"])
    assert isinstance(bases["rf"], FO.Forest) and max(most) == 1
    rows = M.stack_class_predict(bases, meta, table).select("y", "prediction").collect()
    assert len(rows) == 1500 and sum(r["y"] == r["prediction"] for r in rows) > 1400


def test_parts_of_large_forests_are_small():
    sizes = FO.part_trees(300, 20_000, 20, 2)
    assert sum(sizes) == 300 and max(sizes) * 12_600 <= 130_000
