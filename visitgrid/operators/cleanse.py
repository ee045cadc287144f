"""Row filters, key building and scalar feature columns. One narrow projection each, no shuffle
(except ``dedup_rows``). Columns that are absent are skipped."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitgrid import columns as C
from visitgrid.functions.core import (calendar_parts as _parts, cut, floor_days, or_unknown,
                                      package_parts, ts)

# Bucket edges and labels.
LEAD_EDGES = (float("-inf"), -5, 5, 15, float("inf"))
LEAD_LABELS = ("early", "on_time", "slight_delay", "major_delay")
READY_EDGES = (-999, 0, 3, 6, 12, 24, 999)
READY_LABELS = ("done", "0-3m", "3-6m", "6-12m", "12-24m", "24m+")
AGE_EDGES = (-999, 0, 12, 24, 36, 60, 999)
AGE_LABELS = ("in-prod", "0-1y", "1-2y", "2-3y", "3-5y", "5y+")
MISSING_KEYS = ("nan", "", "0", "0.0")
DAYS_PER_MONTH = 30.44


def filter_not_status(df: DataFrame, status=C.STATUS, value=C.CANCELLED) -> DataFrame:
    """Drop rows of one status; rows without a status stay."""
    return df.where(~F.col(status).eqNullSafe(F.lit(value)))


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def normalize_package(df: DataFrame, package=C.PACKAGE) -> DataFrame:
    """Sort the trimmed components of a comma list; repeated components stay."""
    parts = F.transform(F.split(F.col(package), ","), lambda p: F.trim(p))
    return df.withColumn(package, F.array_join(F.sort_array(parts), ", "))


def filter_invalid_packages(df: DataFrame, invalid: Iterable[str], package=C.PACKAGE) -> DataFrame:
    bad = list(invalid)
    if not bad:
        return df
    return df.where(F.col(package).isNull() | ~F.col(package).isin(bad))


def filter_blank_package(df: DataFrame, package=C.PACKAGE) -> DataFrame:
    c = F.trim(F.col(package))
    return df.where(c.isNotNull() & ~c.isin("nan", "<NA>", ""))


def parse_dates(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text to timestamps; what cannot be read becomes null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"))
                           for c in cols if c in df.columns})


def calendar_parts(df: DataFrame, date=C.START) -> DataFrame:
    return df.withColumns(_parts(date))


def lead_time_bucket(df: DataFrame, start=C.START, end=C.END) -> DataFrame:
    if start not in df.columns or end not in df.columns:
        return df
    return df.withColumn("lead_time_category", cut(floor_days(end, start), LEAD_EDGES, LEAD_LABELS))


def _present(c: str) -> Column:
    v = F.col(c).cast("string")
    return F.when(~v.isin(*MISSING_KEYS), v)


def coalesce_join_key(df: DataFrame, order=C.KEY_CHAIN, name=C.JOIN_KEY) -> DataFrame:
    """First usable id along ``order``; ``C.KEY_CHAIN_EFFECTIVE`` gives the other priority."""
    chain = [_present(c) for c in order if c in df.columns]
    return df.withColumn(name, F.coalesce(*chain) if chain else F.lit(None).cast("string"))


def join_key_usage(df: DataFrame, order=C.KEY_CHAIN) -> DataFrame:
    """Rows per id column that supplied the key ("none" where every id is missing)."""
    used = F.lit("none")
    for c in reversed([c for c in order if c in df.columns]):
        used = F.when(_present(c).isNotNull(), F.lit(c)).otherwise(used)
    return df.groupBy(used.alias("key_column")).agg(F.count(F.lit(1)).alias("n"))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def clean_categoricals(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Add ``<c>_clean`` for string columns, missing as UNKNOWN."""
    cols = string_columns(df) if cols is None else [c for c in cols if c in df.columns]
    return df.withColumns({
        f"{c}_clean": F.when(F.col(c) == "nan", F.lit(C.UNKNOWN)).otherwise(or_unknown(c))
        for c in cols})


def age_months(df: DataFrame, as_of) -> DataFrame:
    """Signed distance of the date columns to ``as_of`` in months; positive = future."""
    names = {C.SOP: "vehicle_age_months", C.CAR_READY: "car_ready_age_months",
             C.END: "retrofit_ready_age_months"}
    return df.withColumns({
        out: F.coalesce(floor_days(c, ts(as_of)) / F.lit(DAYS_PER_MONTH), F.lit(0.0))
        for c, out in names.items() if c in df.columns})


def age_buckets(df: DataFrame) -> DataFrame:
    specs = {"car_ready_age_months": ("car_ready_category", READY_EDGES, READY_LABELS),
             "retrofit_ready_age_months": ("retrofit_ready_category", READY_EDGES, READY_LABELS),
             "vehicle_age_months": ("vehicle_age_category", AGE_EDGES, AGE_LABELS)}
    return df.withColumns({
        name: F.coalesce(cut(c, edges, labels), F.lit("nan"))
        for c, (name, edges, labels) in specs.items() if c in df.columns})


def recency_flags(df: DataFrame) -> DataFrame:
    out = {}
    for c, name in (("car_ready_age_months", "is_recent_av_fzg"),
                    ("retrofit_ready_age_months", "is_recent_av_retrofit")):
        if c in df.columns:
            out[name] = ((F.col(c) < 0) & (F.col(c) > -6)).cast("long")
    if "vehicle_age_months" in df.columns:
        out["is_new_vehicle"] = (F.col("vehicle_age_months") > 0).cast("long")
    return df.withColumns(out)


def deadline_features(df: DataFrame, as_of, deadline=C.DEADLINE) -> DataFrame:
    if deadline not in df.columns:
        return df
    return df.withColumns({
        "days_to_deadline": F.coalesce(floor_days(deadline, ts(as_of)), F.lit(999)).cast("double"),
        "has_deadline": F.col(deadline).isNotNull().cast("long")})


def _first(df: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in df.columns), None)


def category_cross(df: DataFrame) -> DataFrame:
    """String crosses of attribute pairs."""
    pairs = {"derivat_x_basistyp": (("derivat",), ("basistyp",)),
             "hybrid_x_antrieb": (("hybrid",), ("antriebsart",)),
             "prio_x_istufe": (("prio",), ("istufe", "current_istufe")),
             "derivat_x_bauphase": (("derivat",), ("pep_bauphase",)),
             "prio_x_ksps": (("prio",), ("ksps", "ist_ksps"))}
    out = {}
    for name, (left, right) in pairs.items():
        a, b = _first(df, *left), _first(df, *right)
        if a and b:
            out[name] = F.concat(or_unknown(a), F.lit("_"), or_unknown(b))
    return df.withColumns(out)


def numeric_interactions(df: DataFrame) -> DataFrame:
    """Products of age, deadline, fleet size and priority columns that exist."""
    def c(name):
        return F.col(name).cast("double")

    have = set(df.columns)
    out = {}
    if {"vehicle_age_months", "derivat_fleet_size"} <= have:
        out["age_x_fleet"] = c("vehicle_age_months") * c("derivat_fleet_size")
    if {"days_to_deadline", "vehicle_age_months"} <= have:
        out["deadline_x_age"] = c("days_to_deadline") * c("vehicle_age_months")
    if {"prio", "derivat_fleet_size"} <= have:
        prio = F.coalesce(F.col("prio").cast("string").try_cast("double"), F.lit(0.0))
        out["prio_x_fleet"] = prio * c("derivat_fleet_size")
    if {"has_deadline", "is_new_vehicle"} <= have:
        out["deadline_x_new"] = c("has_deadline") * c("is_new_vehicle")
    return df.withColumns(out)


def select_features(df: DataFrame, target: str, leaks: Iterable[str] = ()) -> tuple[list, list]:
    """(categorical, numeric) feature names by suffix and type; schema only, no job."""
    banned = C.ID_COLUMNS | {f"{c}_clean" for c in C.ID_COLUMNS} | {target} | set(leaks)
    cat = [c for c in df.columns if c.endswith("_clean") and c not in banned
           and c.removesuffix("_clean") not in set(leaks)]
    raw = {c.removesuffix("_clean") for c in cat}
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
           and f.name not in banned and f.name not in raw]
    return cat, num


def sanitize_nonfinite(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """NaN, null and infinities become 0."""
    inf = F.lit(float("inf"))
    return df.withColumns({
        c: F.when(F.isnan(c) | (F.abs(F.col(c)) == inf) | F.col(c).isNull(), F.lit(0.0))
        .otherwise(F.col(c)) for c in cols})


def nonfinite_counts(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """One row per column with its NaN/null and infinity counts; one pass."""
    cols = list(cols)
    inf = F.lit(float("inf"))
    one = df.agg(*[F.struct(
        F.count_if(F.isnan(c) | F.col(c).isNull()).alias("n_nan"),
        F.count_if(F.abs(F.col(c)) == inf).alias("n_inf")).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.n_nan").alias("n_nan"),
                              F.col(f"{c}.n_inf").alias("n_inf")) for c in cols])
    return one.select(F.inline(rows))


def pairwise_interactions(df: DataFrame, top: list[str], max_pairs=15) -> DataFrame:
    """Products of the first ``max_pairs`` pairs of ``top``, in list order."""
    top = [c for c in top if c in df.columns]
    pairs = [(a, b) for i, a in enumerate(top) for b in top[i + 1:]][:max_pairs]
    return df.withColumns({f"ix_{a[:12]}_{b[:12]}": F.col(a) * F.col(b) for a, b in pairs})


def explode_package(df: DataFrame, package=C.PACKAGE, out="type") -> DataFrame:
    """One row per single type of a package; blanks vanish."""
    return df.withColumn(out, F.explode(package_parts(package)))
