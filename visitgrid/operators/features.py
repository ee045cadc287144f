"""Encodings and label preparation. Maps are fitted on train rows, stored as small tables and
joined; Spark picks broadcast or shuffle from their measured size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgrid import columns as C
from visitgrid.functions.core import floor_days, ratio
from visitgrid.operators.aggregates import unpivot_numeric
from visitgrid.plans.ordered import discrete_quantiles, exact_quantiles, materialize, wide_quantiles


def feature_inventory(df: DataFrame, cat: list[str], num: list[str]) -> DataFrame:
    """(feature, role, n non-null) of the selected features; one pass."""
    cols = [(c, "categorical") for c in cat] + [(c, "numeric") for c in num]
    one = df.agg(*[F.count(c).alias(c) for c, _ in cols])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(r).alias("role"), F.col(c).alias("n"))
        for c, r in cols])))


def medians(df: DataFrame, cols: Iterable[str]) -> dict[str, float]:
    """Exact medians; one number per column reaches the driver."""
    return {r["feature"]: r["m"] for r in wide_quantiles(df, cols, {"m": 0.5}).collect() if r["m"] is not None}


def impute(df: DataFrame, cat: Iterable[str], num: Iterable[str],
           fit_on: DataFrame | None = None) -> DataFrame:
    """Missing text as UNKNOWN, missing numbers as the median (0 without any value).

    The median comes from the whole table unless ``fit_on`` (e.g. the train rows) is given.
    """
    num = list(num)
    med = medians(df if fit_on is None else fit_on, num) if num else {}
    return df.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(C.UNKNOWN)) for c in cat},
        **{c: F.coalesce(F.col(c).cast("double"), F.lit(med.get(c, 0.0))) for c in num}})


def lookup(df: DataFrame, mapping: DataFrame, column: str, key: str, value: str, out: str,
           default) -> DataFrame:
    """``df[column]`` through a (key, value) table, with a default for unknown keys."""
    m = mapping.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    d = default if isinstance(default, Column) else F.lit(default)
    joined = df.join(m, F.col(column) == F.col("__k"), "left")
    return joined.select(*[c for c in df.columns if c != out], F.coalesce("__v", d).alias(out))


def _long_categories(df: DataFrame, cat, keep=()) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                     for c in cat])
    return df.select(*keep, F.inline(rows)).where(F.col("value").isNotNull())


# Feature name of the one row that holds the mean over all train rows.
ALL_ROWS = "*"


def fit_target_means(train: DataFrame, cat, y: str, smoothing: float | None = None) -> DataFrame:
    """(feature, value, enc): mean target per category, optionally shrunk by n / (n + smoothing).

    One pass over the train rows for all columns and the global mean (feature ``ALL_ROWS``),
    written once as the fitted table.
    """
    rows = F.array(F.struct(F.lit(ALL_ROWS).alias("feature"), F.lit("").alias("value")),
                   *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cat])
    long = train.select(F.col(y).cast("double").alias("__y"), F.inline(rows)).where(F.col("value").isNotNull())
    stats = materialize(long.groupBy("feature", "value").agg(
        F.avg("__y").alias("m"), F.count("__y").alias("n")))
    if smoothing is None:
        return stats.select("feature", "value", F.col("m").alias("enc"))
    g = F.lit(global_mean(stats.withColumnRenamed("m", "enc")))
    w = F.col("n") / (F.col("n") + F.lit(float(smoothing)))
    enc = F.when(F.col("feature") == ALL_ROWS, F.col("m")).otherwise(w * F.col("m") + (F.lit(1.0) - w) * g)
    return stats.select("feature", "value", enc.alias("enc"))


def global_mean(table: DataFrame) -> float | None:
    """Mean target of all train rows from a fitted table."""
    row = table.where(F.col("feature") == ALL_ROWS).select("enc").first()
    return None if row is None else row["enc"]


def apply_encoding(df: DataFrame, table: DataFrame, column: str, out: str, value: str, default) -> DataFrame:
    """One column through its part of a fitted (feature, value, ...) table."""
    part = table.where(F.col("feature") == column)
    return lookup(df, part, column, "value", value, out, default)


def target_encode(df: DataFrame, cat: Iterable[str], y: str, split="split",
                  smoothing: float | None = None, suffix="") -> DataFrame:
    """Replace (or suffix) categories by train means; unseen gives the global train mean."""
    cat = list(cat)
    table = fit_target_means(df.where(F.col(split) == "train"), cat, y, smoothing)
    g = global_mean(table)
    for c in cat:
        df = apply_encoding(df, table, c, c + suffix, "enc", g)
    return df


def fit_frequencies(train: DataFrame, cat) -> DataFrame:
    """(feature, value, share) on train rows, written once."""
    counts = (_long_categories(train, cat).groupBy("feature", "value")
              .agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("t"))
    return materialize(counts.join(totals, "feature").select(
        "feature", "value", ratio("n", "t").alias("share")))


def frequency_encode(df: DataFrame, cat: Iterable[str], split="split") -> DataFrame:
    """``<c>_freq``: train share of the category; 0 when unseen."""
    cat = list(cat)
    table = fit_frequencies(df.where(F.col(split) == "train"), cat)
    for c in cat:
        df = apply_encoding(df, table, c, f"{c}_freq", "share", 0.0)
    return df


def group_target_stats(df: DataFrame, y: str, type_col: str, derivat_col: str | None = None,
                       split="split") -> DataFrame:
    """Train-only median and count of the target per type (and median per derivat)."""
    train = df.where((F.col(split) == "train") & F.col(y).isNotNull())
    # one pass: counted (type, value) cells give every statistic of the type
    cells = materialize(train.groupBy(type_col, y).agg(F.count(F.lit(1)).alias("__w")))
    overall = exact_quantiles(cells, [], y, {"m": 0.5}, weight="__w").first()
    overall = overall[0] if overall else None
    med = exact_quantiles(cells, [type_col], y, {"m": 0.5}, weight="__w")
    cnt = cells.groupBy(type_col).agg(F.sum("__w").alias("n"))
    stats = materialize(med.join(cnt, type_col))
    out = df.join(stats.select(F.col(type_col).alias("__k"), F.col("m").alias("__m"), "n"),
                  F.col(type_col) == F.col("__k"), "left").select(
        *df.columns, F.coalesce("__m", F.lit(overall)).alias("type_hist_median"),
        F.coalesce("n", F.lit(0)).alias("type_hist_count"))
    if derivat_col is not None and derivat_col in df.columns:
        dm = materialize(exact_quantiles(train, [derivat_col], y, {"m": 0.5}))
        out = lookup(out, dm, derivat_col, derivat_col, "m", "derivat_hist_median", overall)
    return out


def standalone_rare_remap(df: DataFrame, cls: str, floor: int = 50, share: float = 0.005) -> DataFrame:
    """Rare combinations become their rarest component (by standalone count; first on ties)."""
    # written once: the rows behind the counts are read once, and what joins them has a measured size
    counts = materialize(df.where(F.col(cls).isNotNull()).groupBy(cls).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).scalar()
    limit = F.greatest(F.lit(floor), F.floor(total * F.lit(share)))
    single = counts.where(~F.col(cls).contains(", ")).select(
        F.col(cls).alias("__part"), F.col("__n").alias("__alone"))
    rare = counts.where(F.col(cls).contains(", ") & (F.col("__n") < limit))
    parts = rare.select(cls, F.posexplode(F.split(cls, ", ")).alias("__pos", "__part"))
    best = (parts.join(single, "__part", "left")
            .groupBy(cls).agg(F.min(F.struct(
                F.coalesce("__alone", F.lit(0)).alias("a"), F.col("__pos").alias("i"),
                F.col("__part").alias("p"))).alias("__b"))
            .select(F.col(cls).alias("__c"), F.trim("__b.p").alias("__to")))
    joined = df.join(materialize(best), F.col(cls) == F.col("__c"), "left")
    return joined.select(*[F.coalesce("__to", cls).alias(cls) if c == cls else F.col(c)
                           for c in df.columns])


def filter_rare_classes(df: DataFrame, cls: str, floor: int = 10, share: float = 0.001) -> DataFrame:
    """Keep classes with at least max(floor, share of all rows) rows."""
    return df.join(kept_classes(df, cls, floor, share), cls, "left_semi")


def kept_classes(df: DataFrame, cls: str, floor: int = 10, share: float = 0.001) -> DataFrame:
    """The classes with at least max(floor, share of all rows) rows, at most 1 / share of them."""
    counts = materialize(df.groupBy(cls).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).scalar()
    return materialize(counts.where(F.col("__n") >= F.greatest(F.lit(floor), F.floor(total * F.lit(share)))).select(cls))


def label_codes(df: DataFrame, cls: str, floor: int = 10, share: float = 0.001) -> DataFrame:
    """(class, code) of the classes that are not rare, in alphabetical order. A class has ``share`` of
    the rows or more, so the single-task ranking sees at most 1 / share rows."""
    classes = kept_classes(df.where(F.col(cls).isNotNull()), cls, floor, share)
    return classes.withColumn("code", (F.row_number().over(Window.orderBy(cls)) - 1).cast("long"))


def label_encode(df: DataFrame, cls: str, out="code", floor: int = 10, share: float = 0.001) -> DataFrame:
    """Rows of the classes that are not rare, with the class's code."""
    codes = materialize(label_codes(df, cls, floor, share).withColumnRenamed("code", out))
    return df.join(codes, cls)


def duration_target(df: DataFrame, start=C.START, end=C.END, out=C.DURATION) -> DataFrame:
    """Non-negative whole days between start and end, within the 1st and 99th percentile."""
    d = df.withColumn(out, floor_days(end, start).cast("double")).where(F.col(out) >= 0)
    q = discrete_quantiles(d, [], out, {"lo": 0.01, "hi": 0.99})
    q = q.select(F.struct("lo", "hi").alias("q")).scalar()
    return d.where(F.col(out).between(q["lo"], q["hi"]))
