"""Bootstrap replicates as matrices: weights of rows are drawn where the rows are ranked.

A task holds a range of scores. It draws the weights of a few hundred rows for all replicates at
once, adds them up per cell, and hands on sums per replicate; neither rows nor cells leave it once
per replicate. Ranges are put in order by their sums alone: per range the totals of its first
cell, its last cell and all between, because only these cells can reach into the next range. A range of
few distinct scores hands on every cell, and its weights are drawn only once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid.functions.core import md5_int
from visitgrid.operators.sampling import summed_weights
from visitgrid.plans.ordered import materialize

#: Replicates per row of sums, and weights drawn at once.
SLICE, CHUNK = 250, 400_000
#: Cells that all ranges together may hand on one by one.
KEPT_CELLS = 4096
PARTS = ("pos", "neg", "above_pos", "above_neg", "u")
_ITEMS = "range int, slice int, part int, score double, " + ", ".join(f"{c} array<double>" for c in PARTS)


def _ordered(table):
    """Scores, classes and seeds of a range, by falling score."""
    score = table.column("score").to_numpy()
    order = np.argsort(-score, kind="stable")
    return score[order], table.column("hit").to_numpy()[order].astype(bool), table.column("seed").to_numpy()[order]


def _cells(score, hit, seed, n_boot):
    """(score, pos, neg) of runs of rows by falling score, pos and neg per replicate; rows of one
    score come together unless a chunk ends between them."""
    step = max(1, CHUNK // n_boot)
    for lo in range(0, len(score), step):
        s, h = score[lo:lo + step], hit[lo:lo + step]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        cell, n = np.cumsum(first) - 1, int(first.sum())
        sums = summed_weights(seed[lo:lo + step], 2 * cell + ~h, 2 * n, n_boot)
        yield s[first], sums[0::2], sums[1::2]


def _merged(cells):
    """Cells of one score that two chunks share, as one."""
    held = None
    for score, pos, neg in cells:
        if held is not None and held[0][-1] == score[0]:
            pos[0] += held[1][-1]
            neg[0] += held[2][-1]
            held = tuple(x[:-1] for x in held)
        if held is not None and len(held[0]):
            yield held
        held = (score, pos, neg)
    if held is not None:
        yield held


def _cell_items(key, score, hit, seed, n_boot: int, threshold: float):
    """Every cell as an item of its own; part 1 is left out, which stands for many cells."""
    cells = ((s[i], pos[i], neg[i]) for s, pos, neg in _merged(_cells(score, hit, seed, n_boot)) for i in range(len(s)))
    zero = np.zeros(n_boot)
    rows = []
    for i, (at, pos, neg) in enumerate(cells):
        sums = {"pos": pos.astype(float), "neg": neg.astype(float), "u": zero,
                "above_pos": pos.astype(float) if at >= threshold else zero, "above_neg": neg.astype(float) if at >= threshold else zero}
        rows += [{"range": key, "slice": k, "part": i + 1 if i else 0, "score": at, **{c: v[lo:lo + SLICE] for c, v in sums.items()}}
                 for k, lo in enumerate(range(0, n_boot, SLICE))]
    return rows


def _range_items(key, table, n_boot: int, threshold: float, kept: int = 0):
    score, hit, seed = _ordered(table)
    first, last = score[0], score[-1]
    if 1 + np.count_nonzero(score[1:] != score[:-1]) <= kept:
        return _cell_items(key, score, hit, seed, n_boot, threshold)
    sums = {part: {c: np.zeros(n_boot) for c in PARTS} for part in (0, 1, 2)}
    for s, pos, neg in _merged(_cells(score, hit, seed, n_boot)):
        for part, on in ((0, s == first), (2, (s == last) & (last != first)), (1, (s != first) & (s != last))):
            if on.any():
                p, n, out = pos[on].astype(float), neg[on].astype(float), sums[part]
                below = n.sum(axis=0) - np.cumsum(n, axis=0)
                # positives of earlier chunks are above all negatives of this one
                out["u"] += (p * (below + 0.5 * n)).sum(axis=0) + out["pos"] * n.sum(axis=0)
                out["pos"] += p.sum(axis=0)
                out["neg"] += n.sum(axis=0)
                above = s[on] >= threshold
                out["above_pos"] += p[above].sum(axis=0)
                out["above_neg"] += n[above].sum(axis=0)
    rows = []
    for part, at in ((0, first), (1, np.nan), (2, last)):
        for k, lo in enumerate(range(0, n_boot, SLICE)):
            rows.append({"range": key, "slice": k, "part": part, "score": at, **{c: v[lo:lo + SLICE] for c, v in sums[part].items()}})
    return rows


def _sequence(table):
    """The items of one slice in falling order, boundary cells of one score as one."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["range"], r["part"]))
    out = []
    for r in rows:
        item = {c: np.array(r[c]) for c in PARTS} | {"range": r["range"], "part": r["part"], "score": r["score"]}
        if r["part"] != 1 and out and out[-1]["part"] != 1 and out[-1]["score"] == r["score"]:
            for c in PARTS[:4]:
                out[-1][c] = out[-1][c] + item[c]
        elif r["part"] == 1 or item["pos"].any() or item["neg"].any():
            out.append(item)
    return out


def _precision(pos, tp, fp):
    return np.divide(pos * tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)


def bootstrap_metrics(df: DataFrame, row_id: str, y: str, score: str, n_boot=2000, threshold=0.5) -> DataFrame:
    """Replicate metrics (b, roc_auc, average_precision, f1); one-class replicates drop out.

    Weights are Poisson(1) draws from a row's id, which n draws with replacement tend to. Rows
    without a score do not count.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.where(F.col(score).isNotNull()).select(
        F.col(score).cast("double").alias("score"), F.coalesce(F.col(y) == 1, F.lit(False)).cast("int").alias("hit"),
        md5_int(row_id).alias("seed"))
    ranged = materialize(rows.repartitionByRange(n, F.desc("score"), "seed").withColumn("range", F.spark_partition_id()))

    def items_of(key, table):
        return pa.Table.from_pylist(_range_items(key[0].as_py(), table, n_boot, threshold, max(2, KEPT_CELLS // n)), schema=_arrow(_ITEMS))

    items = materialize(ranged.groupBy("range").applyInArrow(items_of, _ITEMS))

    def offsets_of(key, table):
        tp = fp = 0.0
        rows = []
        for item in _sequence(table):
            if item["part"] == 1:
                rows.append({"range": item["range"], "slice": key[0].as_py(), "tp": tp + np.zeros(len(item["pos"])), "fp": fp + np.zeros(len(item["neg"]))})
            tp, fp = tp + item["pos"], fp + item["neg"]
        return pa.Table.from_pylist(rows, schema=_arrow(_OFFSETS))

    offsets = items.groupBy("slice").applyInArrow(offsets_of, _OFFSETS)

    def inner_of(key, left, right):
        before = sorted(right.to_pylist(), key=lambda r: r["slice"])
        if not before:  # all its cells are items
            return _arrow(_INNER).empty_table()
        tp, fp = (np.concatenate([r[c] for r in before]) for c in ("tp", "fp"))
        score, hit, seed = _ordered(left)
        inside = (score != score[0]) & (score != score[-1])
        total = np.zeros(n_boot)
        for s, pos, neg in _merged(_cells(score[inside], hit[inside], seed[inside], n_boot)):
            p = pos.astype(float)
            tps, fps = tp + np.cumsum(p, axis=0), fp + np.cumsum(neg, axis=0)
            total += _precision(p, tps, fps).sum(axis=0)
            if len(tps):
                tp, fp = tps[-1], fps[-1]
        rows = [{"slice": k, "ap": total[lo:lo + SLICE]} for k, lo in enumerate(range(0, n_boot, SLICE))]
        return pa.Table.from_pylist(rows, schema=_arrow(_INNER))

    inner = ranged.groupBy("range").cogroup(offsets.groupBy("range")).applyInArrow(inner_of, _INNER)

    def metrics_of(key, left, right):
        sequence = _sequence(left)
        width = len(left.column("pos")[0].as_py())
        ap = np.sum([np.zeros(width), *(r["ap"] for r in right.to_pylist())], axis=0)
        tp, fp, u = (np.zeros(len(ap)) for _ in range(3))
        tpa, fpa = np.zeros(len(ap)), np.zeros(len(ap))
        for item in sequence:
            # what came before is above the negatives of this item
            u += tp * item["neg"] + (item["u"] if item["part"] == 1 else 0.5 * item["pos"] * item["neg"])
            tp, fp = tp + item["pos"], fp + item["neg"]
            tpa, fpa = tpa + item["above_pos"], fpa + item["above_neg"]
            if item["part"] != 1:
                ap = ap + _precision(item["pos"], tp, fp)
        on = (tp > 0) & (fp > 0)
        b = np.flatnonzero(on)
        return pa.table({"b": b + SLICE * key[0].as_py(), "roc_auc": (u / np.where(on, tp * fp, 1))[on],
                         "average_precision": (ap / np.where(on, tp, 1))[on], "f1": (2 * tpa / np.where(on, tpa + fpa + tp, 1))[on]})

    return items.groupBy("slice").cogroup(inner.groupBy("slice")).applyInArrow(
        metrics_of, "b long, roc_auc double, average_precision double, f1 double")


_OFFSETS = "range int, slice int, tp array<double>, fp array<double>"
_INNER = "slice int, ap array<double>"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def class_cell_replicates(df: DataFrame, row_id: str, y: str, pred: str, n_boot=1000) -> DataFrame:
    """(b, actual, predicted, n): weighted class cells per replicate.

    A task adds the weights of its rows in a matrix (cell x replicate), which leaves it once, or
    before it outgrows ``CHUNK`` times ten numbers.
    """
    d = df.select(F.col(y).alias("actual"), F.col(pred).alias("predicted"), md5_int(row_id).alias("seed"))
    kinds = dict(d.dtypes)
    schema = f"actual {kinds['actual']}, predicted {kinds['predicted']}, ws array<long>"
    step, room = max(1, CHUNK // n_boot), max(1, 10 * CHUNK // n_boot)

    def add(batches):
        sums: dict = {}

        def out():
            keys = list(sums)
            return pa.RecordBatch.from_pydict({"actual": [k[0] for k in keys], "predicted": [k[1] for k in keys],
                                               "ws": [sums[k] for k in keys]}, schema=arrow)

        arrow = None
        for batch in batches:
            arrow = arrow or pa.schema([batch.schema.field("actual"), batch.schema.field("predicted"), ("ws", pa.list_(pa.int64()))])
            for part in (batch.slice(lo, step) for lo in range(0, batch.num_rows, step)):
                keys = list(zip(part.column("actual").to_pylist(), part.column("predicted").to_pylist()))
                number: dict = {}
                place = np.array([number.setdefault(k, len(number)) for k in keys])
                totals = summed_weights(part.column("seed").to_numpy(), place, len(number), n_boot)
                for k, i in number.items():
                    sums[k] = sums[k] + totals[i] if k in sums else totals[i]
                if len(sums) > room:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    cells = d.mapInArrow(add, schema)
    return (cells.select("actual", "predicted", F.posexplode("ws").alias("b", "w")).where("w > 0")
            .groupBy("b", "actual", "predicted").agg(F.sum("w").alias("n")))
