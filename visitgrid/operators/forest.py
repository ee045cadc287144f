"""Forests fitted in parts: no process holds all trees at once.

Forests on more than a few thousand rows are grown on cells (``operators/cells``); what follows is for
smaller ones, and for those whose cells no task could hold.

The driver grows the trees of a fit and a task receives the trees that score its rows, so a whole forest
of deep trees would have to fit both. A part is a Spark ML forest of as many trees as ``PART_NODES``
allows, written as soon as it is fitted; rows pass the parts one after another and carry the sums. Scoring a part sends
its trees with every job, so the driver scores one part at a time, whoever asks.
"""

from __future__ import annotations

import math
import threading
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitgrid.operators import cells
from visitgrid.plans.ordered import checkpoint_dir, materialize

#: Most nodes of a forest that stays whole, of the trees of a part of a larger one, and parts that the
#: driver grows at a time.
PART_NODES, SPLIT_NODES, PARTS_AT_ONCE = 250_000, 125_000, 3
_GROWING, _SCORING = threading.BoundedSemaphore(PARTS_AT_ONCE), threading.Lock()


def part_trees(trees: int, rows: int, depth: int, least: int) -> list[int]:
    """Trees per part: a tree has at most 2 ** (depth + 1) nodes, and a leaf per ``least`` rows. Of equal
    size but for one tree, so that a part weighs by its trees."""
    # drawn with replacement, some 0.63 of the rows are distinct; leaves seldom are as small as allowed
    nodes = min(2 ** (depth + 1), 2 * max(rows, 1) * 0.63 / max(least, 1))
    total = trees * nodes
    parts = 1 if total <= PART_NODES else min(trees, math.ceil(total / min(PART_NODES, SPLIT_NODES)))
    return [trees // parts + (i < trees % parts) for i in range(parts)]


class Forest(NamedTuple):
    """A fitted forest: folders of its parts with their trees. Transforms and saves like a model."""
    spark: SparkSession
    features: list[str]
    parts: list[tuple[str, int]]

    @property
    def stages(self):
        return [self]

    @property
    def trees(self) -> int:
        return sum(n for _, n in self.parts)

    @property
    def featureImportances(self) -> DenseVector:
        """Every tree's importances sum to one, so parts weigh by their trees."""
        return DenseVector(sum(PipelineModel.load(f).stages[-1].featureImportances.toArray() * n for f, n in self.parts) / self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with ``prediction``, of a classifier also ``probability``. Parts are scored one after
        another, and the rows written in between with the sums so far."""
        x = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep")
        rows = materialize(x.transform(df))
        names, classes = rows.columns, None
        for folder, trees in self.parts:
            with _SCORING:
                model = PipelineModel.load(folder).stages[-1]
                classes = getattr(model, "numClasses", None)
                scored = model.transform(rows)
                if classes is None:
                    own = F.col("prediction") * trees
                    total = own if "__sum" not in rows.columns else F.col("__sum") + own
                else:
                    own = vector_to_array("rawPrediction")
                    total = own if "__sum" not in rows.columns else F.zip_with("__sum", own, lambda a, b: a + b)
                rows = materialize(scored.select(*names, total.alias("__sum")))
                del model, scored
        if classes is None:
            return rows.select(*names, (F.col("__sum") / self.trees).alias("prediction"))
        votes = F.aggregate("__sum", F.lit(0.0), lambda a, b: a + b)
        # the first of equal shares, as in a model
        best = F.array_position("__sum", F.array_max("__sum")) - 1
        out = rows.select(*names, array_to_vector(F.transform("__sum", lambda v: F.when(votes > 0, v / votes).otherwise(v))).alias("probability"),
                          best.cast("double").alias("prediction"))
        # a model's vectors say how long they are, and what assembles them asks for it
        return VectorSizeHint(inputCol="probability", size=classes, handleInvalid="optimistic").transform(out)

    def save(self, folder: str):
        for i, (part, _) in enumerate(self.parts):
            PipelineModel.load(part).write().save(f"{folder}/part-{i}")
        rows = [(i, n, self.features) for i, (_, n) in enumerate(self.parts)]
        self.spark.createDataFrame(rows, "part int, trees int, features array<string>").coalesce(1).write.json(f"{folder}/forest")


def save(model, folder: str):
    model.save(folder) if isinstance(model, Forest | cells.CellForest) else model.write().save(folder)


def load(spark: SparkSession, folder: str):
    """A saved model, in parts, on cells or whole."""
    for read in (_load_parts, cells.load, lambda _, at: PipelineModel.load(at)):
        try:
            return read(spark, folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(folder)


def _load_parts(spark: SparkSession, folder: str) -> Forest:
    rows = spark.read.schema("part int, trees int, features array<string>").json(f"{folder}/forest").orderBy("part").collect()
    return Forest(spark, rows[0]["features"], [(f"{folder}/part-{r['part']}", r["trees"]) for r in rows])


#: Rows from which a forest that one part cannot hold is grown on cells, and from which any forest is.
CELL_ROWS, ALL_CELL_ROWS = 2_000, 20_000


def on_cells(est, rows: int) -> bool:
    """Whether a forest on so many rows is grown on cells."""
    parts = part_trees(est.getNumTrees(), rows, est.getMaxDepth(), est.getMinInstancesPerNode())
    return rows > ALL_CELL_ROWS or (rows > CELL_ROWS and len(parts) > 1)


def fit_forest(make, train: DataFrame, features: list[str]):
    """The forest that ``make(**params)`` describes, on a written train table: one model where its trees
    are small enough, else a Forest of parts. Parts differ by their seed."""
    x = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    # rows remember the node they are in: tasks need no trees
    whole = make(cacheNodeIds=True)
    sizes = part_trees(whole.getNumTrees(), train.count(), whole.getMaxDepth(), whole.getMinInstancesPerNode())

    def grown(est):
        with _GROWING:
            return Pipeline(stages=[x, est]).fit(train)

    if len(sizes) == 1 or whole.getLeafCol():
        return grown(whole)
    folder = f"{checkpoint_dir(train.sparkSession)}/forest-{uuid.uuid4().hex}"

    def part(i):
        model = grown(make(cacheNodeIds=True, numTrees=sizes[i], seed=whole.getSeed() + i))
        model.write().save(f"{folder}/part-{i}")
        return f"{folder}/part-{i}", sizes[i]

    from visitgrid.operators.models import together
    return Forest(train.sparkSession, list(features), together([lambda i=i: part(i) for i in range(len(sizes))], PARTS_AT_ONCE))
