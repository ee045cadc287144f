"""Splits and resampling. Randomness is md5 of a row id, so results never depend on
partitioning and survive a recomputed task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitgrid.functions.core import md5_int, md5_unit
from visitgrid.plans.neighbors import nearest, nearest_indexed
from visitgrid.plans.ordered import exact_quantiles, first_by_hash, materialize, prefix_sums


def hash_split(df: DataFrame, row_id: str, test_pct: int = 20, out="split") -> DataFrame:
    """80/20 split without a shuffle: the id's hash decides (same share in every class)."""
    test = md5_int(row_id) % 100 < test_pct
    return df.withColumn(out, F.when(test, F.lit("test")).otherwise(F.lit("train")))


def stratified_split(df: DataFrame, row_id: str, label: str, test_share=0.2, out="split") -> DataFrame:
    """Exact share per class: the first ``round(share * n)`` ids of a class by hash are test."""
    hashed = df.withColumn("__h", md5_int(row_id))
    quotas = hashed.groupBy(label).agg(F.bround(F.count(F.lit(1)) * F.lit(test_share)).cast("long").alias("__quota"))
    marked = first_by_hash(hashed, [label], "__h", row_id, quotas, "__test")
    return marked.select(*df.columns, F.when(F.col("__test"), F.lit("test")).otherwise(F.lit("train")).alias(out))


def hash_folds(df: DataFrame, row_id: str, k: int = 3, out="fold") -> DataFrame:
    """Folds by the id's hash alone, for targets without classes."""
    return df.withColumn(out, (md5_int(row_id) % k).cast("long"))


def hash_rank(df: DataFrame, row_id: str, label: str, out="rank") -> DataFrame:
    """The rank (from 0) of an id in its class by hash.

    Counts per class and 16-bit hash bucket give the rank where a bucket begins, so only the rows
    of one bucket of one class are sorted together.
    """
    rows = df.withColumn("__h", md5_int(row_id)).withColumn("__hb", F.shiftright(F.col("__h").cast("long"), 16))
    before = Window.partitionBy(label).orderBy("__hb").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(label, "__hb").agg(F.count(F.lit(1)).alias("__n"))
              .select(F.col(label).alias("__l"), F.col("__hb").alias("__b"),
                      F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    inner = F.row_number().over(Window.partitionBy(label, "__hb").orderBy("__h", row_id)) - 1
    joined = rows.withColumn("__i", inner).join(
        starts, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__hb") == F.col("__b")))
    return joined.select(*df.columns, (F.col("__start") + F.col("__i")).cast("long").alias(out))


def stratified_kfold(df: DataFrame, row_id: str, label: str, k: int = 3, out="fold") -> DataFrame:
    """Folds that hold every class to within one row: the rank of an id in its class by hash, mod k."""
    ranked = hash_rank(df, row_id, label, "__rank")
    return ranked.select(*df.columns, F.pmod("__rank", F.lit(k)).cast("long").alias(out))


def chronological_split(series: DataFrame, by, month="month", share=0.8, min_train=0,
                        out="split") -> DataFrame:
    """First ``share`` of each series' months train. A series has one row per month."""
    whole = Window.partitionBy(*by)
    i = F.row_number().over(whole.orderBy(month))
    cutoff = F.greatest(F.floor(F.count(F.lit(1)).over(whole) * F.lit(share)), F.lit(min_train))
    return series.withColumn(out, F.when(i <= cutoff, F.lit("train")).otherwise(F.lit("test")))


def walk_forward_folds(lengths: DataFrame, n_lags: int, n="n") -> DataFrame:
    """Expanding-window folds per series length: (fold, train_end, test_end), 0-based ends."""
    y = F.col(n)
    min_train = F.greatest(F.lit(n_lags + 2), F.floor(y / 3))
    size = F.greatest(F.lit(1), F.floor(y / 6))
    count = F.greatest(F.lit(1), F.floor((y - min_train) / size)).cast("int")
    full = F.filter(
        F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(
            (min_train + k * size).cast("long").alias("train_end"),
            (min_train + (k + 1) * size).cast("long").alias("test_end"))),
        lambda s: s["test_end"] <= y)
    last = F.try_element_at(full, F.lit(-1))["test_end"]
    tail = F.array(F.struct(last.alias("train_end"), y.cast("long").alias("test_end")))
    only = F.array(F.struct(min_train.cast("long").alias("train_end"), y.cast("long").alias("test_end")))
    folds = (F.when(F.size(full) == 0, only)
             .when(last < y, F.concat(full, tail)).otherwise(full))
    keep = [c for c in lengths.columns if c != n]
    return (lengths.select(*keep, n, F.posexplode(folds).alias("fold", "f"))
            .select(*keep, n, F.col("fold").cast("long").alias("fold"), "f.train_end", "f.test_end"))


def cap_sample(df: DataFrame, row_id: str, label: str, cap: int) -> DataFrame:
    """A stratified sample of about ``cap`` rows: each class keeps its share, chosen by hash."""
    hashed = df.withColumn("__h", md5_int(row_id))
    counts = materialize(hashed.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).scalar()
    quotas = counts.select(label, F.when(total <= cap, F.col("__n")).otherwise(
        F.bround(F.col("__n") * F.lit(float(cap)) / total)).cast("long").alias("__quota"))
    return first_by_hash(hashed, [label], "__h", row_id, quotas, "__in").where("__in").select(*df.columns)


def smote(df: DataFrame, row_id: str, vec: str, label: str, minority, ratio=0.6, k=5,
          tile_rows: int | None = None) -> DataFrame:
    """Synthetic minority rows up to ``ratio`` of the largest other class.

    Copy j of row i goes a hashed step toward one of its k nearest minority neighbours
    (squared distance, found tile by tile). Returns (row_id, copy, neighbour, vec).
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    small = df.where(F.col(label) == F.lit(minority))
    mine = F.col(label) == F.lit(minority)
    n_min, n_max = counts.agg(F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)),
                              F.coalesce(F.max(F.when(~mine, F.col("n"))), F.lit(0))).first()
    need = max(0, int(n_max * ratio) - n_min)
    k_eff = min(k, n_min - 1)
    if need == 0 or k_eff < 1:
        return small.limit(0).select(row_id, F.lit(0).cast("long").alias("copy"),
                                     F.col(row_id).alias("neighbour"), vec)
    q = small.select(F.col(row_id).alias("q_id"), F.col(vec).alias("q_vec"))
    b = small.select(F.col(row_id).alias("b_id"), F.col(vec).alias("b_vec"))
    near = nearest(q, b, k_eff, metric="euclidean", tile_rows=tile_rows)
    base, extra = divmod(need, n_min)
    # every row makes `base` copies; the first `extra` rows by hash make one more
    h = small.select(F.col(row_id).alias("q_id"), md5_int(row_id).alias("__h"))
    cells = h.groupBy("__h").agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(cells, [], "__h", ["n"])
    inner = Window.partitionBy("__h").orderBy("q_id")
    pos = (h.withColumn("__i", F.row_number().over(inner))
           .join(ranked.select("__h", (F.col("cum_n") - F.col("n")).alias("__b")), "__h")
           .select("q_id", (F.col("__i") + F.col("__b")).alias("__pos")))
    copies = F.lit(base).cast("long") + (F.col("__pos") <= extra).cast("long")
    todo = (pos.where(copies > 0)
            .select("q_id", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy")))
    tag = F.concat_ws("-", F.col("q_id"), F.col("copy"))
    todo = todo.select("q_id", "copy", (md5_int(tag) % k_eff + 1).alias("rn"),
                       md5_unit(F.concat(tag, F.lit("s"))).alias("step"))
    pick = todo.join(near.select("q_id", "rn", "b_id"), ["q_id", "rn"])
    both = pick.join(q, "q_id").join(b, "b_id")
    mixed = F.zip_with("q_vec", "b_vec", lambda x, y: x + F.col("step") * (y - x))
    return both.select(F.col("q_id").alias(row_id), "copy", F.col("b_id").alias("neighbour"),
                       mixed.alias(vec))


def smote_classes(df: DataFrame, row_id: str, vec: str, label: str, ratio=0.6, k=5, search=nearest_indexed, **index) -> DataFrame:
    """Synthetic rows for every class below ``ratio`` of the largest one, up to that size.

    As ``smote``, for all classes in one pass: neighbours are searched within classes, by ``search``
    (``nearest_indexed``, whose work grows with the rows). A class of n rows uses min(k, n - 1)
    neighbours; a class of one row gets no copies. Returns (row_id, copy, neighbour, label, vec).
    """
    counts = df.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.agg(F.max("__n")).scalar()
    need = materialize(counts.select("__l", "__n", F.greatest(F.floor(top * F.lit(float(ratio))).cast("long") - F.col("__n"), F.lit(0)).alias("__need"),
                                     F.least(F.lit(k), F.col("__n") - 1).cast("long").alias("__k"))
                       .where((F.col("__need") > 0) & (F.col("__k") > 0)))
    small = df.join(need, F.col(label).eqNullSafe(F.col("__l"))).select(row_id, vec, label, "__n", "__need", "__k")
    ranked = materialize(hash_rank(small, row_id, label, "__rank"))
    q = ranked.select(F.col(row_id).alias("q_id"), F.col(vec).alias("q_vec"), F.col(label).alias("__class"))
    b = ranked.select(F.col(row_id).alias("b_id"), F.col(vec).alias("b_vec"), F.col(label).alias("__class"))
    near = search(q, b, k, metric="euclidean", within="__class", **index)
    # every row makes need // n copies; the first need % n rows by hash make one more
    copies = F.floor(F.col("__need") / F.col("__n")) + (F.col("__rank") < F.col("__need") % F.col("__n")).cast("long")
    todo = (ranked.withColumn("__c", copies).where("__c > 0")
            .select(F.col(row_id).alias("q_id"), label, "__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__c"))).alias("copy")))
    listed = near.groupBy("q_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "b_id"))), lambda x: x["b_id"]).alias("__near"))
    tag = F.concat_ws("-", F.col("q_id"), F.col("copy"))
    # a row for which the index met no other one is copied as it is
    at = (md5_int(tag) % F.greatest(F.least(F.col("__k"), F.size("__near")), F.lit(1))).cast("int")
    pick = todo.join(listed, "q_id", "left").select(
        "q_id", label, "copy", F.coalesce(F.get("__near", at), F.col("q_id")).alias("b_id"), md5_unit(F.concat(tag, F.lit("s"))).alias("step"))
    both = pick.join(q.select("q_id", "q_vec"), "q_id").join(b.select("b_id", "b_vec"), "b_id")
    mixed = F.zip_with("q_vec", "b_vec", lambda x, y: x + F.col("step") * (y - x))
    return both.select(F.col("q_id").alias(row_id), "copy", F.col("b_id").alias("neighbour"), label, mixed.alias(vec))


def resampled(train: DataFrame, row_id: str, features, label: str, ratio: float | None, k=5, **index) -> DataFrame:
    """(features..., label, synthetic): the rows, and synthetic ones of every class below ``ratio`` of
    the largest. Without a ratio the rows alone. Null features count as 0 in the synthetic rows."""
    features = list(features)
    rows = train.select(*[F.col(f).cast("double").alias(f) for f in features], label, F.lit(False).alias("synthetic"))
    if ratio is None:
        return rows
    vec = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    more = smote_classes(train.select(row_id, label, vec.alias("__v")), row_id, "__v", label, ratio, k, **index)
    return rows.unionByName(more.select(
        *[F.get("__v", F.lit(i)).alias(f) for i, f in enumerate(features)], label, F.lit(True).alias("synthetic")))


# Cumulative Poisson(1) probabilities for 0..9 events.
POISSON_CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
               0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
               0.999998874797402, 0.9999998885745217)
#: Draws are numbers below this prime; products of two of them fit in 64 bits.
DRAW_PRIME = 2147483647
POISSON_LIMITS = tuple(round(p * DRAW_PRIME) for p in POISSON_CDF)
#: Multipliers of the three mixing rounds.
DRAW_A, DRAW_B, DRAW_C = 1103515245, 69069001, 1664525001


def draw(seed: str, b: str) -> str:
    """SQL text of the draw of replicate ``b`` for a row with 32-bit ``seed``; whole numbers only."""
    x = f"(({seed} % {DRAW_PRIME} + {b} * {DRAW_A} % {DRAW_PRIME} + 1) % {DRAW_PRIME})"
    y = f"(({x} * {x} % {DRAW_PRIME} * {DRAW_B} + {x} + {DRAW_C}) % {DRAW_PRIME})"
    return f"(({y} * {y} % {DRAW_PRIME} + {y} * {DRAW_C}) % {DRAW_PRIME})"


#: Draws made at a time, so that their numbers stay in a processor's cache.
BLOCK = 32_768


def _fold(x: np.ndarray, high: np.ndarray) -> np.ndarray:
    """x, of 0 <= x < 2 ** 63, in place to at most DRAW_PRIME + 1 with the same remainder by DRAW_PRIME =
    2 ** 31 - 1, by folding the high bits twice."""
    for _ in range(2):
        np.right_shift(x, 31, out=high)
        np.bitwise_and(x, DRAW_PRIME, out=x)
        np.add(x, high, out=x)
    return x


def _draws(seeds: np.ndarray, b: np.ndarray, buffers) -> np.ndarray:
    """Draws of some rows in all replicates, in a buffer that the next call overwrites. Numbers between
    the rounds may exceed the prime by one; their products still fit."""
    x, y, high = (buffer[:len(seeds)] for buffer in buffers)
    np.add(seeds[:, None], b, out=x)
    _fold(x, high)
    np.multiply(x, x, out=y)
    _fold(y, high)
    np.multiply(y, DRAW_B, out=y)
    np.add(y, x, out=y)
    np.add(y, DRAW_C, out=y)
    _fold(y, high)
    np.add(y, DRAW_C, out=x)
    np.multiply(y, x, out=y)  # y * y + y * DRAW_C
    _fold(y, high)
    np.subtract(y, DRAW_PRIME, out=y, where=y >= DRAW_PRIME)
    return y


def _blocks(seeds: np.ndarray, n_boot: int):
    """(first row, draws) of a few rows at a time."""
    b = np.arange(n_boot, dtype=np.int64) * DRAW_A % DRAW_PRIME
    base = seeds.astype(np.int64) % DRAW_PRIME + 1
    step = max(1, BLOCK // max(n_boot, 1))
    buffers = [np.empty((step, n_boot), np.int64) for _ in range(3)]
    for lo in range(0, len(seeds), step):
        yield lo, _draws(base[lo:lo + step], b, buffers)


def draws(seeds: np.ndarray, n_boot: int) -> np.ndarray:
    """``draw`` of every seed (rows) and replicate (columns)."""
    out = np.empty((len(seeds), n_boot), np.int64)
    for lo, m in _blocks(seeds, n_boot):
        out[lo:lo + len(m)] = m
    return out


def poisson_weights(seeds: np.ndarray, n_boot: int) -> np.ndarray:
    """Poisson(1) resampling weights of rows (by their 32-bit seeds) in all replicates.

    With-replacement counts of n rows tend to independent Poisson(1) draws, so no replicate
    needs an index join.
    """
    w = np.zeros((len(seeds), n_boot), np.int16)
    for lo, m in _blocks(seeds, n_boot):
        m, own = m.astype(np.int32), np.zeros(m.shape, np.int8)
        for limit in POISSON_LIMITS:
            above = m >= limit
            if not above.any():
                break
            own += above.view(np.int8)
        w[lo:lo + len(m)] = own
    return w


def summed_weights(seeds: np.ndarray, groups: np.ndarray, n_groups: int, n_boot: int) -> np.ndarray:
    """Weights added up per group (0 .. n_groups - 1) of the rows, in all replicates."""
    out = np.zeros((n_groups, n_boot), np.int64)
    order = np.argsort(groups, kind="stable")
    groups, w = groups[order], poisson_weights(seeds[order], n_boot)
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else groups
    for lo, hi in zip(starts, [*starts[1:], len(groups)]):
        # runs are summed in narrow numbers: a weight is at most ten
        out[groups[lo]] = sum(w[at:min(at + 3000, hi)].sum(axis=0, dtype=np.int16) for at in range(lo, hi, 3000))
    return out


def percentile_interval(samples: DataFrame, keys, value: str, ci: float = 0.95) -> DataFrame:
    """Percentile interval, spread and count of replicate metrics."""
    a = (1 - ci) / 2
    base = samples.groupBy(*keys).agg(F.stddev_pop(value).alias("std"), F.count(value).alias("n_boot"))
    q = exact_quantiles(samples, keys, value, {"ci_lo": a, "ci_hi": 1 - a})
    return base.join(q, list(keys)) if keys else base.withColumn(
        "ci_lo", q.select("ci_lo").scalar()).withColumn("ci_hi", q.select("ci_hi").scalar())
