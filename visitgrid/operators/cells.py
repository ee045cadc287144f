"""Tree models on cells: all rows count, and rows that no split can tell apart are one row.

Trees cut a feature at no more than ``BINS - 1`` places, near the quantiles of all rows (or at all
values of a feature that has few). Rows with one bin in every feature and one label are a cell
with a count; a fit reads cells and counts, and every row of a cell gets the cell's prediction.

A forest's trees are grown by independent tasks, a tree at a time, on a written table of cells. Row
weights of a tree are Poisson draws as in Spark ML's forests: a cell of n rows draws from Poisson(n),
the sum of n draws from Poisson(1). Splits, features per node, leaves and votes follow Spark ML too.
Trees and cells go through files that the workers open by ``pyarrow.fs``; nothing passes the driver.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitgrid.plans.ordered import materialize

#: Bins per feature (as in Spark ML), and features whose bins one long holds.
BIN_BITS, PACKED = 5, 12
BINS = 1 << BIN_BITS
#: Buckets to a factor of two in which values are counted to find the cuts.
FINE = 1024
#: Memory of the cells of a fit in a task (beyond it a forest is fitted in parts by Spark ML), trees per
#: task, and distinct rows that a task scores at a time.
CELL_BYTES, TREES_AT_ONCE, SCORED = 400_000_000, 6, 50_000
#: What an estimator may have set for its forest to be grown on cells.
KNOWN = {"labelCol", "featuresCol", "weightCol", "numTrees", "maxDepth", "minInstancesPerNode", "seed", "leafCol", "cacheNodeIds"}


def cuts_of(df: DataFrame, features: list[str]) -> list[list[float]]:
    """Per feature the values at which trees may cut (below | from here on): every value but the least
    where there are at most BINS, else values near the quantiles of all rows.

    A value's bucket is the logarithm of its distance from the least one, FINE buckets to a factor of two;
    rows are counted per bucket, and the least value of the bucket in which a quantile falls is a cut. Counts
    and least values do not depend on the order of the rows.
    """
    finite = {f: F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")) for f in features}
    facts = df.agg(*[F.struct(F.approx_count_distinct(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_if(v.isNull()).alias("bad")).alias(f"f{i}")
                     for i, v in enumerate(finite.values())]).first()
    if bad := [f for f, fact in zip(features, facts) if fact["bad"]]:  # as Spark ML's fits
        raise ValueError(f"features must be finite numbers in every train row: {', '.join(bad)}")
    few = [i for i in range(len(features)) if facts[i]["n"] <= 1.5 * BINS]
    values = df.agg(*[F.collect_set(finite[features[i]]) for i in few]).first() if few else []
    exact = {i: v[1:] for i, found in zip(few, values) if len(v := sorted(set(found))) <= BINS}
    spots = [F.struct(F.lit(i).alias("i"), finite[f].alias("v"), F.lit(facts[i]["lo"]).alias("lo"), F.lit(facts[i]["hi"]).alias("hi"))
             for i, f in enumerate(features) if i not in exact]
    if spots:
        far = F.log2((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        at = F.floor(F.greatest(far, F.lit(-30.0)) * FINE)  # null for the least value itself: a bucket of its own
        counts = (df.select(F.inline(F.array(*spots))).where("v is not null").groupBy("i", at.alias("at"))
                  .agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")))
        per = Window.partitionBy("i").orderBy("v")
        upto = per.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        place = counts.select("i", "v", "n", F.sum("n").over(upto).alias("to"), F.sum("n").over(Window.partitionBy("i")).alias("all"))
        # the buckets that hold one of the ranks all * k / BINS
        hit = F.floor((F.col("to") - 1) * BINS / F.col("all")) > F.floor((F.col("to") - F.col("n") - 1) * BINS / F.col("all"))
        for i in range(len(features)):
            exact.setdefault(i, [])
        for r in place.where(hit & (F.col("to") > F.col("n"))).select("i", "v").collect():  # at most BINS - 1 per feature
            exact[r["i"]].append(r["v"])
    # each value once: 0.0 and -0.0 are one
    return [sorted(set(exact[i]) - {facts[i]["lo"]}) for i in range(len(features))]


def bucketizer(features: list[str], cuts: list[list[float]]) -> Bucketizer:
    ends = [[float("-inf"), *c, float("inf")] if c else [float("-inf"), 0.0, float("inf")] for c in cuts]
    return Bucketizer(splitsArray=ends, inputCols=list(features), outputCols=[f"__bin_{f}" for f in features], handleInvalid="keep")


def binned(df: DataFrame, features: list[str], cuts: list[list[float]]) -> DataFrame:
    """The rows with ``__cell_0``, ...: their bins, as digits of longs. Missing values are in the last bin."""
    cast = df.withColumns({f"__x_{i}": F.col(f).cast("double") for i, f in enumerate(features)})
    rows = bucketizer([f"__x_{i}" for i in range(len(features))], cuts).transform(cast)
    bins = [F.coalesce(F.least(F.col(f"__bin___x_{i}"), F.lit(float(len(c)))), F.lit(float(len(c)))).cast("long") if c else F.lit(0).cast("long")
            for i, c in enumerate(cuts)]
    keys = [sum((b * BINS ** j for j, b in enumerate(bins[at:at + PACKED])), F.lit(0).cast("long")) for at in range(0, len(bins), PACKED)]
    return rows.select(*df.columns, *[k.alias(f"__cell_{i}") for i, k in enumerate(keys)])


def keys_of(n_features: int) -> list[str]:
    return [f"__cell_{i}" for i in range(math.ceil(n_features / PACKED))]


def unpacked(keys: list[np.ndarray], n_features: int) -> np.ndarray:
    """Bins (rows x features) of packed keys."""
    return np.stack([(keys[i // PACKED] // BINS ** (i % PACKED)) % BINS for i in range(n_features)], axis=1).astype(np.uint8)


def files(folder: str):
    """(file system, paths) of a written table, in a fixed order."""
    fs, root = FileSystem.from_uri(folder)
    return fs, sorted(f.path for f in fs.get_file_info(FileSelector(root)) if f.path.endswith(".parquet"))


def folder_of(written: DataFrame) -> str:
    return written.inputFiles()[0].rsplit("/", 1)[0]


def table_of(folder: str) -> pa.Table:
    fs, paths = files(folder)
    return pa.concat_tables([pq.read_table(fs.open_input_file(p)) for p in paths])


def impurity(stat: np.ndarray, weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(raw count, weight, impurity) of rows of sums: per class counts (Gini), or count, sum and sum of squares (variance)."""
    if weights is None:
        n = np.maximum(stat[:, 0], 1e-300)
        return stat[:, 0], stat[:, 0], np.maximum(stat[:, 2] / n - (stat[:, 1] / n) ** 2, 0.0)
    w = stat * weights
    total = w.sum(1)
    return stat.sum(1), total, 1 - ((w / np.maximum(total, 1e-300)[:, None]) ** 2).sum(1)


class Tree(NamedTuple):
    feature: np.ndarray  # int16; -1 for a leaf
    cut: np.ndarray      # uint8; bins up to it go left
    left: np.ndarray     # int32; the right child comes next to it; of a leaf its number
    leaves: np.ndarray   # (leaves, sums)

    def packed(self) -> bytes:
        head = np.array([len(self.feature), *self.leaves.shape, self.leaves.dtype == np.float64], dtype=np.int64)
        return zlib.compress(b"".join(a.tobytes() for a in (head, self.feature, self.cut, self.left, self.leaves)), 1)

    @staticmethod
    def unpacked(data: bytes) -> Tree:
        data = zlib.decompress(data)
        n, rows, sums, real = np.frombuffer(data, np.int64, 4)
        at, out = 32, []
        for kind, size in ((np.int16, n), (np.uint8, n), (np.int32, n), (np.float64 if real else np.int32, rows * sums)):
            out.append(np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return Tree(*out[:3], out[3].reshape(rows, sums))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The number of the leaf of every row of bins."""
        node = np.zeros(len(x), dtype=np.int32)
        at = np.flatnonzero(self.feature[node] >= 0)
        while len(at):
            here = node[at]
            node[at] = self.left[here] + (x[at, self.feature[here]] > self.cut[here])
            at = at[self.feature[node[at]] >= 0]
        return self.left[node]


def best_splits(x, stat, own, total, sub, weights, least):
    """(gain, feature, bin, left sums) of the best split of every node among its features ``sub``."""
    m = len(total)
    before = np.cumsum(total, axis=0) - total
    raw, weight, bad = impurity(total, weights)
    gain, feature, cut = np.full(m, -np.inf), np.zeros(m, np.int16), np.zeros(m, np.uint8)
    left = np.zeros_like(total)
    flat, base = x.reshape(-1), np.arange(0, x.size, x.shape[1])
    for j in range(sub.shape[1]):
        key = own * np.int32(BINS) + flat.take(base + sub[:, j].take(own))
        order = np.argsort(key)
        key = key.take(order)
        # the last row of every (node, bin); a node's last bin leaves nothing to its right
        end = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        node = key[end] // BINS
        inner = np.flatnonzero(node[1:] == node[:-1])
        if not len(inner):
            continue
        sums = np.cumsum(stat.take(order, axis=0), axis=0, dtype=total.dtype).take(end[inner], axis=0)
        node, bins = node[inner], key[end[inner]] % BINS
        lefts = sums - before[node]
        (ln, lw, li), (rn, rw, ri) = impurity(lefts, weights), impurity(total[node] - lefts, weights)
        g = bad[node] - (lw * li + rw * ri) / weight[node]
        g[(ln < least) | (rn < least)] = -np.inf
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        top = np.maximum.reduceat(g, start)
        hit = np.flatnonzero(g == np.repeat(top, np.diff(np.append(start, len(g)))))
        hit = hit[np.append(True, node[hit][1:] != node[hit][:-1])]
        better = hit[g[hit] > gain[node[hit]]]
        to = node[better]
        gain[to], feature[to], cut[to], left[to] = g[better], sub[to, j], bins[better], lefts[better]
    return gain, feature, cut, left


def grow(rng, x, stat, weights, subset: int, depth: int, least: int) -> tuple[Tree, np.ndarray]:
    """A tree, level by level, and the importance of every feature (summing to one, or all zero)."""
    rows = np.flatnonzero(stat.any(axis=1))
    x, stat = x[rows], stat[rows]
    n_features = x.shape[1]
    own = np.zeros(len(x), dtype=np.int32)
    sums = [stat.sum(axis=0, keepdims=True)]
    _, _, first = impurity(sums[0], weights)
    slight = 1e-12 * max(first[0], 1e-300)
    features, cuts, lefts = [np.full(1, -1, np.int16)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)]
    made, total, gains = 1, sums[0], [np.zeros(1)]
    ids = np.zeros(1, dtype=np.int64) if depth > 0 and first[0] > slight and impurity(total, weights)[0][0] >= 2 * least else np.zeros(0, np.int64)
    if not len(ids):
        x = x[:0]
    f_all, c_all, l_all = (np.concatenate(a) for a in (features, cuts, lefts))
    level = 0
    while len(ids):
        if subset < n_features:
            sub = np.argsort(rng.random((len(ids), n_features)), axis=1)[:, :subset]
        else:
            sub = np.broadcast_to(np.arange(n_features), (len(ids), n_features))
        gain, feature, cut, left = best_splits(x, stat, own, total, sub, weights, least)
        split = np.flatnonzero(gain > slight)
        gains[-1][ids[split] - (made - len(gains[-1]))] = gain[split] * impurity(total[split], weights)[1]
        # children come next to each other, in the order of their parents
        child = np.full(len(ids), -1, dtype=np.int64)
        child[split] = 2 * np.arange(len(split))
        f_all[ids[split]], c_all[ids[split]], l_all[ids[split]] = feature[split], cut[split], made + child[split]
        both = np.empty((2 * len(split), total.shape[1]), dtype=total.dtype)
        both[0::2], both[1::2] = left[split], total[split] - left[split]
        sums.append(both)
        gains.append(np.zeros(len(both)))
        f_all, c_all, l_all = (np.concatenate([a, np.full(len(both), v, a.dtype)]) for a, v in ((f_all, -1), (c_all, 0), (l_all, 0)))
        level += 1
        raw, _, bad = impurity(both, weights)
        open_ = (bad > slight) & (raw >= 2 * least) & (level < depth)
        # where a row of each node goes: the places of its children among the open nodes, or nowhere
        place = np.where(open_, np.cumsum(open_) - 1, -1).astype(np.int32)
        goes = np.full((len(ids), 2), -1, dtype=np.int32)
        goes[split] = place.reshape(-1, 2)
        right = x.reshape(-1).take(np.arange(0, x.size, n_features) + feature.take(own)) > cut.take(own)
        to = goes.reshape(-1).take(2 * own + right)
        stay = np.flatnonzero(to >= 0)
        x, stat, own = x.take(stay, axis=0), stat.take(stay, axis=0), to.take(stay)
        ids, total = made + np.flatnonzero(open_), both[open_]
        made += len(both)
    return pruned(f_all, c_all, l_all, np.concatenate(sums), weights, np.concatenate(gains), n_features)


def pruned(feature, cut, left, sums, weights, gains, n_features: int) -> tuple[Tree, np.ndarray]:
    """The tree without splits whose two leaves predict the same, renumbered (children keep to pairs), and
    the importances of its features."""
    predicts = (sums * weights).argmax(1) if weights is not None else sums[:, 1] / np.maximum(sums[:, 0], 1e-300)
    while True:
        inner = np.flatnonzero(feature >= 0)
        a = left[inner]
        gone = inner[(feature[a] < 0) & (feature[a + 1] < 0) & (predicts[a] == predicts[a + 1])]
        if not len(gone):
            break
        feature[gone] = -1
    kept = np.zeros(len(feature), dtype=bool)
    level = np.zeros(1, dtype=np.int64)
    while len(level):
        kept[level] = True
        down = left[level[feature[level] >= 0]]
        level = np.concatenate([down, down + 1])
    number = np.cumsum(kept) - 1
    feature, cut, left, sums = feature[kept], cut[kept], left[kept], sums[kept]
    leaf = feature < 0
    left = np.where(leaf, np.cumsum(leaf) - 1, number[np.where(leaf, 0, left)]).astype(np.int32)
    importance = np.bincount(feature[~leaf], gains[kept][~leaf], n_features)
    total = importance.sum()
    return Tree(feature, cut, left, sums[leaf] if weights is None else sums[leaf].astype(np.int32)), importance / total if total > 0 else importance


def read_cells(folder: str, n_features: int, classes: int):
    """(bins of the distinct cells, entry's cell, label, rows) of a written table, in a fixed order."""
    t = table_of(folder)
    keys = [t[k].to_numpy() for k in keys_of(n_features)]
    y, n = t["y"].to_numpy(), t["n"].to_numpy()
    order = np.lexsort((y, *keys))
    keys, y, n = [k[order] for k in keys], y[order], n[order]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))[:len(y)]
    return unpacked([k[new] for k in keys], n_features), np.cumsum(new) - 1, y, n


def grower(folder: str, n_features: int, classes: int, weights, subset: int, depth: int, least: int, seed: int):
    """The function of a task: trees of the numbers it is given."""
    def run(batches):
        cells = None
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                if cells is None:
                    cells = read_cells(folder, n_features, classes)
                x, at, y, n = cells
                rng = np.random.default_rng([seed & 0xFFFFFFFF, tree])
                drawn = rng.poisson(n)
                if classes:
                    stat = np.zeros((len(x), classes), dtype=np.int32 if n.sum() < 2 ** 29 else np.int64)
                    stat[at, y.astype(np.int64)] = drawn
                else:
                    stat = np.stack([np.bincount(at, drawn * v, len(x)) for v in (np.ones(len(y)), y, y * y)], axis=1)
                grown, importance = grow(rng, x, stat, weights, subset, depth, least)
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int64()), pa.array([grown.packed()], pa.binary()),
                                                  pa.array([importance.tolist()], pa.list_(pa.float64()))], names=["tree", "data", "importance"])
    return run


def scorer(folder: str, n_features: int, weights, leaves: bool):
    """The function of a task: the mean vote (or value) of all trees for each cell, and its leaves."""
    names = keys_of(n_features)

    def each_tree():
        fs, paths = files(folder)
        for p in paths:
            for batch in pq.ParquetFile(fs.open_input_file(p)).iter_batches(1, columns=["tree", "data"]):
                yield batch.column(0)[0].as_py(), Tree.unpacked(batch.column(1)[0].as_py())

    def scored(batch):
        x = unpacked([batch.column(k).to_numpy() for k in names], n_features)
        total, at, found = np.zeros((len(x), 1 if weights is None else len(weights))), {}, 0
        for number, tree in each_tree():
            value = tree.leaves[:, 1:2] / np.maximum(tree.leaves[:, :1], 1e-300) if weights is None else tree.leaves * weights
            if weights is not None:
                value = value / np.maximum(value.sum(1, keepdims=True), 1e-300)
            leaf = tree.leaf_of(x)
            total += value[leaf]
            found += 1
            if leaves:
                at[number] = leaf
        # summed file by file: rounded, so that the trees' places among files do not show
        lists = np.round(total / found, 12)
        columns = [*(batch.column(k) for k in names), pa.array(lists.tolist(), pa.list_(pa.float64()))]
        if leaves:
            columns.append(pa.array(np.stack([at[k] for k in sorted(at)], axis=1).tolist(), pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=[*names, "__vote", "__leaves"][:len(columns)])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SCORED:
                yield scored(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, n = [], 0
        if n:
            yield scored(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    return run


class CellForest(NamedTuple):
    """A forest grown on cells. Transforms and saves like a model."""
    spark: SparkSession
    features: list[str]
    cuts: list[list[float]]
    weights: list[float]  # per class; empty for a regression
    leaf_col: str
    folder: str           # the written trees

    @property
    def stages(self):
        return [self]

    @property
    def trees(self) -> DataFrame:
        return self.spark.read.schema("tree long, data binary, importance array<double>").parquet(self.folder)

    @property
    def featureImportances(self) -> DenseVector:
        rows = np.array([r["importance"] for r in self.trees.select("importance", "tree").orderBy("tree").collect()])
        total = rows.sum()
        return DenseVector(rows.sum(0) / total if total > 0 else rows.sum(0))

    def scored(self, cells: DataFrame) -> DataFrame:
        """(cell, __vote, [__leaves]) of distinct cells."""
        names = keys_of(len(self.features))
        schema = ", ".join([*(f"{k} long" for k in names), "__vote array<double>", *["__leaves array<int>"] * bool(self.leaf_col)])
        weights = np.array(self.weights) if self.weights else None
        return cells.select(*names).mapInArrow(scorer(self.folder, len(self.features), weights, bool(self.leaf_col)), schema)

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with ``prediction``, of a classifier also ``probability``: cells are scored once each."""
        names = keys_of(len(self.features))
        rows = binned(df, self.features, self.cuts)
        cells = materialize(rows.select(*names).distinct())
        tasks = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-cells.count() // 2000)))
        votes = materialize(self.scored(cells.repartition(tasks, *names)))
        out = rows.join(votes, names).drop(*names)
        if self.leaf_col:
            out = out.withColumn(self.leaf_col, array_to_vector(F.col("__leaves").cast("array<double>"))).drop("__leaves")
        if not self.weights:
            return out.withColumn("prediction", F.get("__vote", F.lit(0))).drop("__vote")
        # the first of equal shares, as in a model
        best = F.array_position("__vote", F.array_max("__vote")) - 1
        out = out.withColumns({"probability": array_to_vector("__vote"), "prediction": best.cast("double")}).drop("__vote")
        return VectorSizeHint(inputCol="probability", size=len(self.weights), handleInvalid="optimistic").transform(out)

    def save(self, folder: str):
        self.trees.write.parquet(f"{folder}/trees")
        row = (self.features, [list(map(float, c)) for c in self.cuts], list(map(float, self.weights)), self.leaf_col)
        self.spark.createDataFrame([row], META).coalesce(1).write.json(f"{folder}/cells")


META = "features array<string>, cuts array<array<double>>, weights array<double>, leaf_col string"


def load(spark: SparkSession, folder: str) -> CellForest:
    r = spark.read.schema(META).json(f"{folder}/cells").first()
    return CellForest(spark, r["features"], r["cuts"], r["weights"], r["leaf_col"], folder_of(spark.read.parquet(f"{folder}/trees")))


def cells_of(df: DataFrame, features: list[str], cuts, label: str) -> DataFrame:
    """(cells, y, n): the counted cells of all rows, written."""
    rows = binned(df.select(*dict.fromkeys(features), F.col(label).cast("double").alias("y")), features, cuts)
    return materialize(rows.groupBy(*keys_of(len(features)), "y").agg(F.count(F.lit(1)).alias("n")))


def class_weights(cells: DataFrame, balanced: bool) -> list[float]:
    """Weight per class code: n / (classes * n_class) when balanced, as ``models.class_weights``."""
    counts = {r["y"]: r["n"] for r in cells.groupBy("y").agg(F.sum("n").alias("n")).collect()}  # at most as many as classes
    if any(y is None or y != y or y < 0 or y != int(y) for y in counts):
        raise ValueError("class labels must be 0, 1, ... and not null")
    n = sum(counts.values())
    return [n / (len(counts) * counts[float(c)]) if balanced and float(c) in counts else 1.0 for c in range(int(max(counts)) + 1)]


def balance():
    """The weight of a cell's rows that gives every class the same sum, as a function of the cells."""
    def weight(cells: DataFrame):
        by = class_weights(cells, True)
        return F.get(F.array(*[F.lit(w) for w in by]), F.col("y").cast("int"))
    return weight


def grow_forest(est, train: DataFrame, features: list[str], classify: bool, balanced: bool):
    """The forest that ``est`` describes, on all rows; None where its cells are too many for a task's
    memory or a parameter is not known here."""
    if any(est.isSet(p) and p.name not in KNOWN for p in est.params):
        return None
    features, spark, label = list(features), train.sparkSession, est.getLabelCol()
    cuts = cuts_of(train, features)
    cells = cells_of(train, features, cuts, label)
    if not classify and cells.where("y is null or isnan(y)").limit(1).count():
        raise ValueError("targets must be numbers")
    weights = class_weights(cells, balanced) if classify else []
    if cells.count() * (len(features) + 60 + 12 * max(len(weights), 6)) > CELL_BYTES or len(weights) > 100:
        return None
    n_trees = est.getNumTrees()
    share = math.ceil(math.sqrt(len(features))) if classify else math.ceil(len(features) / 3)
    subset = len(features) if n_trees == 1 else share
    run = grower(folder_of(cells), len(features), len(weights), np.array(weights) if classify else None, subset,
                 est.getMaxDepth(), est.getMinInstancesPerNode(), est.getSeed())
    parts = max(1, math.ceil(n_trees / TREES_AT_ONCE))
    trees = materialize(spark.range(0, n_trees, 1, parts).mapInArrow(run, "tree long, data binary, importance array<double>"))
    return CellForest(spark, features, cuts, weights, est.getLeafCol(), folder_of(trees))


def fit_on_cells(est, train: DataFrame, features: list[str], weight=None) -> PipelineModel:
    """A model without bootstrap fitted on the counted cells: sums over cells are sums over all rows.
    ``weight``: a function of (cells) to the column that a row of a cell weighs."""
    features = list(features)
    cuts = cuts_of(train, features)
    cells = cells_of(train, features, cuts, est.getLabelCol())
    # the bins themselves are the features; every boundary between them is a possible split
    bins = [f"__bin_{f}" for f in features]
    digits = [F.shiftright(F.col(f"__cell_{i // PACKED}"), BIN_BITS * (i % PACKED)).bitwiseAND(F.lit(BINS - 1).cast("long"))
              .cast("double").alias(bins[i]) for i in range(len(features))]
    w = F.col("n").cast("double") if weight is None else F.col("n") * weight(cells)
    x = VectorAssembler(inputCols=bins, outputCol="features", handleInvalid="keep")
    rows = x.transform(cells.select(*digits, F.col("y").alias(est.getLabelCol()), w.alias("__w")))
    model = est.setWeightCol("__w").fit(rows)
    return PipelineModel([bucketizer(features, cuts), x, model])
