"""Summary tables. Group sizes are aggregated first and joined back, so a hot group is
combined map-side instead of being sorted in one window task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitgrid import columns as C
from visitgrid.functions.core import floor_days, month_start, ratio
from visitgrid.plans.ordered import discrete_quantiles, exact_quantiles, materialize, top_rows, wide_quantiles


def _one() -> Column:
    return F.count(F.lit(1))


def unpivot_numeric(df: DataFrame, cols, keep=(), name="feature", value="value") -> DataFrame:
    """Long form (keep..., feature, value) of numeric columns."""
    rows = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
                     for c in cols])
    return df.select(*keep, F.inline(rows))


def _inline(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*structs)))


def missing_pct(df: DataFrame, top: int = 20) -> DataFrame:
    """Percent null per column, largest first, only columns with nulls; one pass."""
    one = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in df.columns])
    out = _inline(one, [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_pct"))
                        for c in df.columns])
    return (out.where(F.col("missing_pct") > 0)
            .orderBy(F.desc("missing_pct"), F.asc("column")).limit(top))


def describe_numeric(df: DataFrame, cols=None, digits=3) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column (exact quartiles)."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    out = wide_quantiles(df, cols, {"q25": .25, "q50": .5, "q75": .75}, count=F.count, mean=F.avg, std=F.stddev_samp,
                         min=F.min, max=F.max)
    return out.select("feature", "count", *[
        (F.round(c, digits) + F.lit(0.0)).alias(c)
        for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def histogram(df: DataFrame, value: str, bins: int, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Equal-width bins between the extremes (or given bounds); the last bin is closed."""
    if lo is None or hi is None:
        lo_c = df.agg(F.min(value)).scalar().cast("double")
        hi_c = df.agg(F.max(value)).scalar().cast("double")
    else:
        lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
    v = F.col(value).cast("double")
    b = F.least(F.width_bucket(v, lo_c, hi_c, F.lit(bins)), F.lit(bins))
    b = F.when(lo_c == hi_c, F.lit(1)).otherwise(b).cast("long")
    return (df.where(v.isNotNull() & (v >= lo_c) & (v <= hi_c))
            .groupBy(b.alias("bin")).agg(_one().alias("n")))


def target_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share per class, with the ratio of the largest class to this one."""
    counts = df.groupBy(label).agg(_one().alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    top = counts.agg(F.max("n")).scalar()
    return counts.select(F.col(label).cast("string").alias("class"), "n",
                         ratio("n", total).alias("share"), ratio(top, "n").alias("imbalance"))


def monthly_volume(df: DataFrame, date=C.START) -> DataFrame:
    d = df.where(F.col(date).isNotNull())
    return d.groupBy(month_start(date).alias("month")).agg(_one().alias("n"))


def top_types(counts: DataFrame, column: str, n: int, weight="n") -> list[str]:
    """The n largest values of a count table (ties by name): at most n strings reach the driver."""
    d = counts.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum(weight).alias("__w"))
    rows = d.orderBy(F.desc("__w"), F.asc(column)).limit(n).collect()
    return [r[0] for r in rows]


def topn_pivot(cells: DataFrame, keys, type_col: str, n=8, other="Other", weight="n") -> DataFrame:
    """Wide counts for the n most frequent types, the rest as one column.

    ``cells`` is an aggregated (keys, type, count) table; it is written once, so the rows
    behind it are read once although the column list depends on the counts.
    """
    cells = materialize(cells)
    top = top_types(cells, type_col, n, weight)
    bucket = F.when(F.col(type_col).isin(top), F.col(type_col)).otherwise(F.lit(other))
    return (cells.select(*keys, bucket.alias("__t"), F.col(weight).alias("__w"))
            .groupBy(*keys).pivot("__t", [*top, other]).agg(F.sum("__w")).fillna(0))


def monthly_volume_topn_pivot(df: DataFrame, date=C.START, package=C.PACKAGE, n=8,
                              other="Other") -> DataFrame:
    """Month x type counts for the n most frequent types, the rest as one column."""
    cells = (df.where(F.col(date).isNotNull())
             .groupBy(month_start(date).alias("month"), package).agg(_one().alias("n")))
    return topn_pivot(cells, ["month"], package, n, other)


def historical_pivot(df: DataFrame, date=C.START, package=C.PACKAGE, types=None) -> DataFrame:
    """Month x type counts, zero filled. Without ``types`` Spark finds them (bounded by
    spark.sql.pivotMaxValues, above which it refuses)."""
    d = df.where(F.col(date).isNotNull() & F.col(package).isNotNull())
    return (d.select(month_start(date).alias("month"), F.col(package).alias("__t"))
            .groupBy("month").pivot("__t", types).agg(_one()).fillna(0))


def with_group_size(df: DataFrame, keys, name: str) -> DataFrame:
    """Rows per key group as a column; 0 where a key is null."""
    keys = list(keys)
    # written first: the rows are shuffled by the key only if the table of sizes is measured as large
    sizes = materialize(df.dropna(subset=keys).groupBy(*keys).agg(_one().alias(name)))
    out = df.join(sizes, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select(*df.columns, name)


def group_count_transform(df: DataFrame, date=C.START, package=C.PACKAGE,
                          name="monthly_retrofit_count") -> DataFrame:
    """Visits of the same package in the same month; 0 without a date."""
    tmp = df.withColumn("__month", month_start(date))
    return with_group_size(tmp, ["__month", package], name).drop("__month")


def value_counts(df: DataFrame, cols) -> DataFrame:
    """(feature, value, n) of several columns in one pass, written once as a fitted table."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                     for c in cols])
    long = df.select(F.inline(rows)).where(F.col("value").isNotNull())
    return materialize(long.groupBy("feature", "value").agg(_one().alias("n")))


def _join_value(df: DataFrame, table: DataFrame, column: str, value: Column, out: str) -> DataFrame:
    """Join one feature's fitted value to the rows; 0 where the row has no value."""
    t = table.where(F.col("feature") == column).select(
        F.col("value").alias("__k"), value.alias("__v"))
    joined = df.join(t, F.col(column).cast("string") == F.col("__k"), "left")
    return joined.select(*[c for c in df.columns if c != out],
                         F.coalesce("__v", F.lit(0)).alias(out))


def fleet_size(df: DataFrame, names: dict[str, str], counts: DataFrame | None = None) -> DataFrame:
    """Frequency of each row's category value, per column that exists."""
    names = {c: o for c, o in names.items() if c in df.columns}
    counts = value_counts(df, names) if counts is None else counts
    for c, out in names.items():
        df = _join_value(df, counts, c, F.col("n"), out)
    return df


def common_flag(df: DataFrame, column: str, name: str, counts: DataFrame | None = None) -> DataFrame:
    """1 where the value is more frequent than the median frequency of the distinct values."""
    counts = value_counts(df, [column]) if counts is None else counts
    med = discrete_quantiles(counts.where(F.col("feature") == column), [], "n", {"m": 0.5}).scalar()
    return _join_value(df, counts, column, (F.col("n") > med).cast("long"), name)


def frequency_feature(df: DataFrame, names: dict[str, str], counts: DataFrame | None = None) -> DataFrame:
    """Share of each row's value among non-null rows, per column that exists."""
    names = {c: o for c, o in names.items() if c in df.columns}
    counts = value_counts(df, names) if counts is None else counts
    # one total per column
    totals = {r["feature"]: r["t"] for r in
              counts.groupBy("feature").agg(F.sum("n").alias("t")).collect()}
    for c, out in names.items():
        df = _join_value(df, counts, c, F.col("n") / F.lit(float(totals.get(c, 1))), out)
    return df


def type_stats(df: DataFrame, group: str, value: str, discrete=False) -> DataFrame:
    """median, mean, std (sample) and count per group; exact median.

    ``discrete``: the caller knows that the value has few distinct values (whole days); one pass then
    does it all, with a buffer of these values per group.
    """
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    base = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), _one().alias("count")]
    if discrete:
        return discrete_quantiles(d, [group], value, {"median": 0.5}, *base)
    return d.groupBy(group).agg(*base).join(exact_quantiles(d, [group], value, {"median": 0.5}), group)


def with_type_group(df: DataFrame, mapping: DataFrame, package=C.PACKAGE, out="type_group") -> DataFrame:
    """Coarse group of each package from a (package, type_group) mapping table; else null."""
    m = mapping.select(F.col("package").alias("__p"), F.col("type_group").alias(out))
    return df.join(m, F.col(package) == F.col("__p"), "left").drop("__p")


def visit_stats(df: DataFrame, key=C.JOIN_KEY) -> DataFrame:
    """Visits per entity: mean and median."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(_one().alias("visits"))
    return discrete_quantiles(per, [], "visits", {"median": 0.5}, _one().alias("entities"),
                              F.avg("visits").alias("mean"), F.max("visits").alias("max"))


def visit_distribution(df: DataFrame, key=C.JOIN_KEY) -> DataFrame:
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(_one().alias("visits"))
    return per.groupBy("visits").agg(_one().alias("entities"))


def visits_per_entity(df: DataFrame, category: str, key=C.JOIN_KEY) -> DataFrame:
    """(key, category, total): an entity's visits, under its first category by name."""
    return (df.where(F.col(key).isNotNull() & F.col(category).isNotNull())
            .groupBy(key).agg(F.min(category).alias(category), _one().alias("total")))


def mean_visits_per_category(per_entity: DataFrame, category: str) -> DataFrame:
    return per_entity.groupBy(category).agg(F.avg("total").alias("mean_visits"))


def visits_per_category(df: DataFrame, category: str, key=C.JOIN_KEY) -> DataFrame:
    """Mean total visits per category; an entity counts for its first category by name."""
    return mean_visits_per_category(visits_per_entity(df, category, key), category)


def monthly_series(df: DataFrame, target: str, date=C.START, by=(), fill_gaps=False) -> DataFrame:
    """Monthly count and mean of the target; months without rows appear only with ``fill_gaps``."""
    d = df.where(F.col(date).isNotNull() & F.col(target).isNotNull())
    by = list(by)
    out = d.groupBy(*by, month_start(date).alias("month")).agg(
        _one().alias("n"), F.avg(target).alias("mean_target"))
    if not fill_gaps:
        return out
    span = out.groupBy(*by).agg(F.min("month").alias("__a"), F.max("month").alias("__b"))
    grid = span.select(*by, F.explode(F.sequence("__a", "__b", F.expr("interval 1 month")))
                       .alias("month"))
    return (grid.join(out, [*by, "month"], "left")
            .fillna({"n": 0}).withColumn("mean_target", F.coalesce("mean_target", F.lit(0.0))))


def class_feature_summary(df: DataFrame, label: str, num=(), cat=()) -> DataFrame:
    """Per class: mean of numeric columns, most frequent value of string columns."""
    num, cat = list(num), list(cat)
    parts = []
    if num:
        long = unpivot_numeric(df, num, keep=[label])
        parts.append(long.groupBy(label, "feature").agg(F.avg("value").alias("mean"))
                     .select(label, "feature", "mean", F.lit(None).cast("string").alias("mode")))
    if cat:
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in cat])
        counts = (df.select(label, F.inline(rows)).where(F.col("v").isNotNull())
                  .groupBy(label, "feature", "v").agg(_one().alias("n")))
        # most frequent value, ties to the smallest: ordered minimum of (-n, value)
        best = counts.groupBy(label, "feature").agg(
            F.min(F.struct(-F.col("n"), F.col("v").alias("v"))).alias("b"))
        parts.append(best.select(label, "feature", F.lit(None).cast("double").alias("mean"),
                                 F.col("b.v").alias("mode")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every column pair in one pass, long form."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"__{i}")
                   for i, (a, b) in enumerate(pairs)])
    return _inline(one, [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                  F.col(f"__{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])


def train_test_drift(df: DataFrame, cols, split="split") -> DataFrame:
    """|test mean - train mean| in train standard deviations, per feature; one pass."""
    cols = list(cols)
    tr, te = F.col(split) == "train", F.col(split) == "test"
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.avg(F.when(tr, v)).alias(f"m{i}"), F.avg(F.when(te, v)).alias(f"t{i}"),
                 F.greatest(F.stddev_samp(F.when(tr, v)), F.lit(1e-8)).alias(f"s{i}")]
    out = _inline(df.agg(*aggs), [F.struct(
        F.lit(c).alias("feature"), F.abs((F.col(f"t{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias("z"),
        F.col(f"m{i}").alias("train_mean"), F.col(f"t{i}").alias("test_mean"))
        for i, c in enumerate(cols)])
    return out.withColumn("drifted", (F.col("z") > 1).cast("long")).orderBy(F.desc("z"))


def majority_vote(df: DataFrame, row: str, prediction: str, probability: str) -> DataFrame:
    """Most frequent prediction (ties to the smallest) and mean probability per row."""
    cells = df.groupBy(row, prediction).agg(
        _one().alias("n"), F.sum(probability).alias("s"), F.count(probability).alias("c"))
    return cells.groupBy(row).agg(
        F.min(F.struct(-F.col("n"), F.col(prediction).alias("v"))).alias("b"),
        F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("n").alias("votes")).select(
        row, F.col("b.v").alias("prediction"), ratio("s", "c").alias("probability"), "votes")


def mutual_information(df: DataFrame, label: str, cols, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each numeric column with the label.

    A column is cut at its own quantiles, so bins hold about equally many rows and an outlier moves
    no edge. A value equal to an edge falls below it.
    """
    cols = list(cols)
    d = df.select(label, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    # bins - 1 numbers per column
    edges = {r["feature"]: [r[f"e{i}"] for i in range(1, bins)]
             for r in wide_quantiles(d, cols, {f"e{i}": i / bins for i in range(1, bins)}).collect()}

    def bin_of(c):
        inner = sorted({e for e in edges[c] if e is not None})
        return sum(((F.col(c) > F.lit(e)).cast("int") for e in inner), F.lit(1))

    rows = F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c).cast("long").alias("bin"))
                     for c in cols])
    # cells: features x bins x classes
    cells = (d.select(label, F.inline(rows)).groupBy("feature", "bin", label)
             .agg(_one().alias("n")))
    nx = Window.partitionBy("feature", "bin")
    ny = Window.partitionBy("feature", label)
    nn = Window.partitionBy("feature")
    term = (F.col("n") / F.col("nn")) * F.log(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny")))
    return (cells.select("*", F.sum("n").over(nx).alias("nx"), F.sum("n").over(ny).alias("ny"),
                         F.sum("n").over(nn).alias("nn"))
            .groupBy("feature").agg(F.sum(term).alias("mi")))


def mutual_info_topk(df: DataFrame, label: str, num, cat=(), k: int = 15, bins: int = 10) -> DataFrame:
    """String columns first, then the numeric columns with the highest mutual information."""
    cat, num = list(cat)[:k], list(num)
    mi = mutual_information(df, label, num, bins)
    top = mi.orderBy(F.desc("mi"), F.asc("feature")).limit(max(0, k - len(cat)))
    out = top.select("feature", F.lit("numeric").alias("kind"), "mi")
    if cat:
        names = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit("categorical").alias("kind"),
                                   F.lit(None).cast("double").alias("mi")) for c in cat])
        out = df.limit(1).select(F.inline(names)).unionByName(out)
    return out


def consensus_importance(importances: DataFrame, top: int = 15) -> DataFrame:
    """Mean importance per feature over (model, feature, importance) rows, top first."""
    return (importances.groupBy("feature").agg(F.avg("importance").alias("importance"))
            .orderBy(F.desc("importance"), F.asc("feature")).limit(top))


def visit_gaps(df: DataFrame, key=C.JOIN_KEY, start=C.START, extra=()) -> DataFrame:
    """Floor-days between consecutive distinct visit times of an entity.

    Visits at the same instant only add zero gaps, which no statistic counts, so times are
    made distinct first. A hot entity is then sorted month by month, and each month takes
    the last time of the entity's previous month from a small table.
    """
    extra = list(extra)
    d = (df.where(F.col(key).isNotNull() & F.col(start).isNotNull())
         .select(key, F.col(start).alias("__t"), *extra))
    d = d.groupBy(key, "__t", *extra).agg(F.count(F.lit(1)).alias("__n"))
    d = d.withColumn("__m", F.date_trunc("day", F.col("__t")))
    days = d.groupBy(key, "__m").agg(F.max("__t").alias("__last"))
    prev = days.select(key, "__m", F.lag("__last").over(
        Window.partitionBy(key).orderBy("__m")).alias("__before"))
    inside = Window.partitionBy(key, "__m").orderBy("__t", *extra)
    local = d.withColumn("__p", F.lag("__t").over(inside))
    out = local.join(prev, [key, "__m"]).withColumn("__p", F.coalesce("__p", "__before"))
    return out.select(key, *extra, F.col("__t").alias(start),
                      floor_days("__t", "__p").alias("gap"))


def inter_visit_gap(df: DataFrame, key=C.JOIN_KEY, start=C.START, gaps: DataFrame | None = None) -> DataFrame:
    """Median and mean of the gaps between 0 and 1000 days (both excluded)."""
    g = visit_gaps(df, key, start) if gaps is None else gaps
    g = g.where((F.col("gap") > 0) & (F.col("gap") < 1000))
    return discrete_quantiles(g, [], "gap", {"median_days": 0.5}, F.count(F.lit(1)).alias("n"),
                              F.avg("gap").alias("mean_days"))


def inter_visit_gap_by_category(df: DataFrame, category: str, key=C.JOIN_KEY, start=C.START,
                                gaps: DataFrame | None = None) -> DataFrame:
    """Median gap (1 to 999 days) per category; pass ``gaps`` to share one gap table."""
    g = visit_gaps(df, key, start, [category]) if gaps is None else gaps
    g = g.where(F.col("gap").between(1, 999) & F.col(category).isNotNull())
    return discrete_quantiles(g, [category], "gap", {"median_days": 0.5})


def cap_per_class(df: DataFrame, label: str, order, quota: int) -> DataFrame:
    """At most ``quota`` rows per class, smallest ``order`` first (a stratified sample)."""
    return top_rows(df, [label], order, quota).drop("rn")
