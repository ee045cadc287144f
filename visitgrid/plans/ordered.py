"""Order-dependent building blocks that stay distributed when one key holds most rows.

A window over (key) sorts a whole key in one task. The helpers here first shrink the input to
cells (one row per key and value), then cut the cells by global value ranges, so no task sees
more than one range of one key. There is one plan for every size and every orderable type.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: list[tempfile.TemporaryDirectory] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder (spark.checkpoint.dir).

    Only a session on one machine may go without: it gets a temporary folder. On a cluster the
    executors would write to their own disks, so a missing setting is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="visitgrid-"))
    return _LOCAL[0].name


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result once, as a table in the shared checkpoint folder.

    Cuts the lineage, survives lost executors, and gives later joins its measured size.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def value_cells(df: DataFrame, keys, value, **sums) -> DataFrame:
    """One row per (keys, value) with the given sums; combines map-side before the shuffle."""
    aggs = [F.sum(c).alias(n) for n, c in sums.items()] or [F.count(F.lit(1)).alias("n")]
    return df.groupBy(*keys, value).agg(*aggs)


def prefix_sums(cells: DataFrame, keys, value: str, sums, descending=False,
                ranges: int | None = None) -> DataFrame:
    """Add ``cum_<s>`` (inclusive running sum in value order) and ``tot_<s>`` per key.

    ``cells`` must hold one row per (keys, value) and a non-null value of any orderable type. The
    cells are written once, cut in value ranges (as many as the session's shuffle partitions, or
    ``ranges``); a running sum inside a range starts at the totals of the ranges before it.
    """
    keys, sums = list(keys), list(sums)
    spark = cells.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    names = cells.columns
    # the range number is written with the cells, so every reader sees the same cut
    ranged = materialize(cells.repartitionByRange(n, value, *keys).withColumn("__b", F.spark_partition_id()))
    key_cols = [F.col(k) for k in keys]
    totals = ranged.groupBy(*keys, "__b").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    b_order = F.col("__b").desc() if descending else F.col("__b").asc()
    before = Window.partitionBy(*key_cols).orderBy(b_order).rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key_cols)
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__ob"),
        *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__off_{s}") for s in sums],
        *[F.sum(f"__{s}").over(whole).alias(f"tot_{s}") for s in sums])
    order = F.col(value).desc() if descending else F.col(value).asc()
    run = Window.partitionBy(*key_cols, F.col("__b")).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(s).over(run).alias(f"__run_{s}") for s in sums])
    on = F.col("__b") == F.col("__ob")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return local.join(offsets, on).select(
        *names, *[(F.col(f"__run_{s}") + F.col(f"__off_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"tot_{s}") for s in sums])


#: Ranks of the sketch are off by at most rows / ACCURACY; brackets reach twice as far. Up to twice as
#: many rows that is less than a few ranks, and the bracket is open: the sketch holds such keys whole.
ACCURACY = 10_000


def _marks(value: str, probs: dict[str, float], accuracy: int) -> list:
    """Aggregates of the first pass: lower and upper bracket of every quantile (null: open)."""
    many = F.count(value) > 2 * accuracy
    reach = 2.0 / accuracy
    ends = [max(p - reach, 0.0) for p in probs.values()], [min(p + reach, 1.0) for p in probs.values()]
    lo, hi = (F.percentile_approx(value, F.array(*[F.lit(e) for e in es]), F.lit(accuracy)) for es in ends)
    # the sketch's own ends are exact only by this
    lo = F.transform(lo, lambda x, i: F.when(F.get(F.lit(ends[0]), i) == 0, F.lit(None)).otherwise(x))
    hi = F.transform(hi, lambda x, i: F.when(F.get(F.lit(ends[1]), i) == 1, F.lit(None)).otherwise(x))
    none = F.array_repeat(F.lit(None), len(probs))
    return [F.when(many, lo).otherwise(none).alias("__lo"), F.when(many, hi).otherwise(none).alias("__hi")]


def _picked(cells: DataFrame, facts: DataFrame, keys, probs: dict[str, float]) -> DataFrame:
    """Quantiles from cells (keys, __p, __v, __n) inside the brackets and facts (keys, __tot, __below)."""
    keys = list(keys)
    run = Window.partitionBy(*keys, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cells.withColumn("__cum", F.sum("__n").over(run))
    named = facts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__tot", "__below")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = ranked.join(named, on) if keys else ranked.select(
        "*", *[named.select(c).scalar().alias(c) for c in ("__tot", "__below")])
    end = F.col("__cum") + F.get("__below", F.col("__p"))
    aggs = []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("__tot") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("__p") == i) & (end - F.col("__n") <= at) & (at < end)
            aggs.append(F.max(F.when(hit, F.col("__v").cast("double"))).alias(f"__{side}_{name}"))
    out = joined.groupBy(*keys).agg(F.max("__tot").alias("__tot"), *aggs)
    cols = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__tot") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        missed = F.when(F.col("__tot") > 0, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
        cols.append(F.when(lo.isNotNull() & hi.isNotNull(), lo + (hi - lo) * (pos - F.floor(pos))).otherwise(missed).alias(name))
    return out.select(*keys, *cols)


def _inside(v, lo, hi):
    return (lo.isNull() | (v >= lo)) & (hi.isNull() | (v <= hi))


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float], weight: str | None = None,
                    accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles with linear interpolation, one output column per entry of ``probs``.

    Two passes over (keys, value), which are written once. The first keeps a mergeable sketch per key
    and takes a bracket around every quantile from it. The second counts the rows below a bracket
    and the distinct values inside it; only these, a few thousandths of the rows, are shuffled and
    ranked. ``weight``: rows are already counted cells, and all of them are ranked.
    """
    keys = list(keys)
    if weight is not None:
        return _cell_quantiles(df, keys, value, probs, weight)
    number = F.col(value) if dict(df.dtypes)[value] not in ("float", "double") else F.nanvl(F.col(value).cast("double"), F.lit(None))
    rows = materialize(df.select(*keys, number.alias("__v")).where(F.col("__v").isNotNull()))
    first = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__tot"), *_marks("__v", probs, accuracy)))
    if keys:
        marks = first.select(*[F.col(k).alias(f"__m_{k}") for k in keys], "__lo", "__hi")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__m_{k}"))
        marked = rows.join(marks, on)
    else:
        marked = rows.select("*", *[first.select(c).scalar().alias(c) for c in ("__lo", "__hi")])
    below = [F.count_if(F.col("__v") < F.get("__lo", F.lit(i))) for i in range(len(probs))]
    facts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__tot"), F.array(*below).alias("__below"))
    spots = F.filter(F.array(*[F.lit(i) for i in range(len(probs))]), lambda i: _inside(
        F.col("__v"), F.get("__lo", i), F.get("__hi", i)))
    cells = marked.select(*keys, "__v", F.explode(spots).alias("__p")).groupBy(*keys, "__p", "__v").agg(F.count(F.lit(1)).alias("__n"))
    return _picked(cells, facts, keys, probs)


def wide_quantiles(df: DataFrame, cols, probs: dict[str, float], accuracy: int = ACCURACY, **stats) -> DataFrame:
    """(feature, [stats], quantiles) of many numeric columns: the two passes of ``exact_quantiles`` for
    all columns at once, over the source itself. ``stats``: functions of a column to an aggregate,
    taken along in the first pass. Rows are never exploded, only their values inside a bracket."""
    cols = list(cols)

    def v(c):
        return F.nanvl(F.col(c).cast("double"), F.lit(None))

    numbers = df.select(*[v(c).alias(c) for c in cols])
    aggs = [F.struct(F.count(c).alias("__tot"), *_marks(c, probs, accuracy), *[fn(c).alias(n) for n, fn in stats.items()]).alias(c) for c in cols]
    facts = materialize(numbers.agg(*aggs))
    marks = facts.first()  # one row: 2 numbers per column and quantile
    # a row of brackets is small and the same for all rows: literals
    bounds = {c: list(zip(marks[c]["__lo"] or [], marks[c]["__hi"] or [])) for c in cols}
    low = numbers.agg(*[F.array(*[F.count_if(F.col(c) < F.lit(lo)) if lo is not None else F.lit(0).cast("long") for lo, _ in bounds[c]])
                        .cast("array<bigint>").alias(c) for c in cols]).first()
    spots = F.filter(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("__p"), F.when(
        _inside(F.col(c), F.lit(lo).cast("double"), F.lit(hi).cast("double")), F.col(c)).alias("__v"))
        for c in cols for i, (lo, hi) in enumerate(bounds[c])] or [F.struct(F.lit("").alias("feature"), F.lit(0).alias("__p"), F.lit(
            None).cast("double").alias("__v"))]), lambda x: x["__v"].isNotNull())
    cells = numbers.select(F.inline(spots)).groupBy("feature", "__p", "__v").agg(F.count(F.lit(1)).alias("__n"))
    known = df.sparkSession.createDataFrame([(c, marks[c]["__tot"], list(low[c])) for c in cols], "feature string, __tot long, __below array<long>")
    found = _picked(cells, known, ["feature"], probs)
    table = facts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("__f"), *[F.col(c)[n].alias(n) for n in stats]) for c in cols])))
    return table.join(found, F.col("__f") == F.col("feature"), "left").select(F.col("__f").alias("feature"), *stats, *probs)


def _cell_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float], weight: str) -> DataFrame:
    """Exact quantiles of counted cells, by running counts over distinct values."""
    cells = value_cells(df.where(F.col(value).isNotNull()), keys, value, __cnt=F.col(weight))
    ranked = prefix_sums(cells, keys, value, ["__cnt"])
    lo_rank = F.col("cum___cnt") - F.col("__cnt")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("tot___cnt") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (lo_rank <= at) & (at < F.col("cum___cnt"))
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"__{side}_{name}"))
    out = ranked.groupBy(*keys).agg(F.max("tot___cnt").alias("__tot"), *aggs)
    cols = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__tot") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *cols)


def discrete_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float], *aggs) -> DataFrame:
    """Exact quantiles of a column with few distinct values (whole days, counts), in one pass.

    The aggregate keeps a count per distinct value, so its memory is the number of distinct
    values, not of rows: day spans have at most a few thousand, and counts per group at most
    sqrt(2 * rows). Use ``exact_quantiles`` for continuous columns.
    """
    q = [F.percentile(value, F.lit(float(p))).alias(n) for n, p in probs.items()]
    return df.groupBy(*keys).agg(*aggs, *q)


def first_by_hash(df: DataFrame, keys, hash_col: str, row_id: str, quotas: DataFrame, out: str) -> DataFrame:
    """Mark the first rows per key in (hash, id) order; ``quotas``: (keys, __quota), one row per key.

    ``hash_col`` is a 32-bit number. Counts per key and 16-bit hash bucket find the bucket where
    a key's quota ends: rows of lower buckets are in, of higher ones out, and only the rows of
    that one bucket (1/65536 of a key) are sorted.
    """
    keys = list(keys)
    bucket = F.shiftright(F.col(hash_col).cast("long"), 16)
    rows = df.withColumn("__hb", bucket)
    cells = rows.groupBy(*keys, "__hb").agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(*keys).orderBy("__hb").rowsBetween(Window.unboundedPreceding, -1)
    named = quotas.select(*[F.col(k).alias(f"__q_{k}") for k in keys], "__quota")

    def same(other, prefix):
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(other[f"{prefix}{k}"])
        return on

    ends = (cells.withColumn("__before", F.coalesce(F.sum("__n").over(run), F.lit(0)))
            .join(named, same(named, "__q_")).where(
                (F.col("__before") < F.col("__quota")) & (F.col("__before") + F.col("__n") >= F.col("__quota"))))
    ends = materialize(ends.select(*[F.col(k).alias(f"__e_{k}") for k in keys], F.col("__hb").alias("__cut"),
                                   (F.col("__quota") - F.col("__before")).alias("__left")))
    # a key without an end has quota 0 (all out) or more than its rows, which quotas rule out
    joined = rows.join(ends, same(ends, "__e_"), "left")
    tied = F.coalesce(F.col("__hb") == F.col("__cut"), F.lit(False))
    plain = joined.where(~tied).withColumn(out, F.coalesce(F.col("__hb") < F.col("__cut"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_col, row_id))
    cut = joined.where(tied).withColumn(out, rank <= F.col("__left"))
    return plain.unionByName(cut).select(*df.columns, out)


def top_rows(df: DataFrame, keys, order, k: int, rank="rn") -> DataFrame:
    """The first ``k`` rows per key by ``order``; keys are cut down per input partition first.

    ``order`` must be a total order. A hot key is sorted in as many parts as the input has
    partitions, and only k rows of each part reach the last step.
    """
    order = list(order)
    salted = df.withColumn("__salt", F.spark_partition_id())
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    cut = salted.withColumn("__rn", F.row_number().over(part)).where(F.col("__rn") <= k)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (cut.drop("__rn", "__salt")
            .withColumn(rank, F.row_number().over(final).cast("long"))
            .where(F.col(rank) <= k))
