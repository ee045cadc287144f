"""From scored entities to dated, calibrated visits and the month x type forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgrid import columns as C
from visitgrid.functions.core import add_days, month_index, month_start, package_parts, ratio, ts
from visitgrid.operators.features import lookup
from visitgrid.plans.ordered import materialize, prefix_sums


def select_unseen(df: DataFrame, as_of, label=C.LABEL, months=6) -> DataFrame:
    """Entities without a visit whose deadline (else SOP column) is absent or not long past."""
    out = df.where(F.col(label) == 0)
    anchor = next((c for c in (C.DEADLINE, C.SOP) if c in df.columns), None)
    if anchor is None:
        return out
    cutoff = ts(as_of) - F.make_interval(months=F.lit(months))
    return out.where(F.col(anchor).isNull() | (F.col(anchor) >= cutoff))


def build_scoring_matrix(df: DataFrame, encodings: DataFrame, frequencies: DataFrame | None,
                         cat: list[str], num: list[str], global_mean: float,
                         interactions: list[tuple[str, str]] = ()) -> DataFrame:
    """Feature columns of new rows from fitted maps; absent columns take their default.

    ``encodings``: (feature, value, enc); ``frequencies``: (feature, value, share).
    """
    from visitgrid.operators.features import apply_encoding
    out = df
    for c in cat:
        if c in df.columns:
            out = apply_encoding(out, encodings, c, f"enc_{c}", "enc", global_mean)
            if frequencies is not None:
                out = apply_encoding(out, frequencies, c, f"{c}_freq", "share", 0.0)
        else:
            out = out.withColumn(f"enc_{c}", F.lit(float(global_mean)))
            if frequencies is not None:
                out = out.withColumn(f"{c}_freq", F.lit(0.0))
    out = out.withColumns({
        f"num_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
        for c in num})
    return out.withColumns({
        f"ix_{a[:12]}_{b[:12]}": F.coalesce(F.col(a).cast("double"), F.lit(0.0))
        * F.coalesce(F.col(b).cast("double"), F.lit(0.0))
        for a, b in interactions if a in df.columns and b in df.columns})


def k_per_entity(df: DataFrame, category: str, means: DataFrame, global_mean, out="k") -> DataFrame:
    """Visits to expect: ceil of the category's mean visits, else of the global mean, else 1."""
    g = global_mean if isinstance(global_mean, Column) else F.lit(global_mean).cast("double")
    g = F.coalesce(F.nanvl(g, F.lit(1.0)), F.lit(1.0))
    joined = lookup(df, means, category, category, "mean_visits", out, g)
    return joined.withColumn(out, F.ceil(out).cast("long"))


def affinity_penalty(p: Column, cls, typical, penalty=C.ATYPICAL_PENALTY) -> Column:
    """Ranking weight of classes outside a group's typical components (no set: unchanged)."""
    odd = typical.isNotNull() & ~F.arrays_overlap(package_parts(cls), typical)
    return F.when(odd, p * F.lit(penalty)).otherwise(p)


def mismatch_penalty(p: Column, cls, forbidden, penalty=C.MISMATCH_PENALTY) -> Column:
    """Ranking weight of classes that touch a priority's forbidden components."""
    bad = forbidden.isNotNull() & F.arrays_overlap(package_parts(cls), forbidden)
    return F.when(bad, p * F.lit(penalty)).otherwise(p)


def component_sets(mapping: dict[str, set], key: Column) -> Column:
    """A configured value -> component-set map as an array column (null when not listed)."""
    out = F.lit(None).cast("array<string>")
    for name, parts in mapping.items():
        out = F.when(key == F.lit(name), F.array(*[F.lit(p) for p in sorted(parts)])).otherwise(out)
    return out


def top_k_classes(probs: DataFrame, entity: str, k, rank_by="p", code="code",
                  out="visit_number") -> DataFrame:
    """K most likely classes per entity as visits 1..K; ties to the higher class code.

    A group is one entity's classes, so its size is the number of classes.
    """
    w = Window.partitionBy(entity).orderBy(F.desc(rank_by), F.desc(code))
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    return (probs.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= limit))


def min_probability(df: DataFrame, p="p", floor=C.MIN_TYPE_PROBABILITY) -> DataFrame:
    return df.where(F.col(p) >= floor)


def calibration_weight(df: DataFrame, factors: DataFrame, package: str, out="calibration_weight") -> DataFrame:
    """Factor of the whole package string, 1 when it has none (combinations never do)."""
    return lookup(df, factors, package, "type", "factor", out, 1.0)


def max_visit(df: DataFrame, key: str, visit="visit_number", out="max_visit") -> DataFrame:
    """Highest visit number per key, aggregated and joined back."""
    m = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(visit).alias("__m"))
    j = df.join(m, F.col(key) == F.col("__k"), "left")
    return j.select(*df.columns, F.coalesce("__m", visit).alias(out))


def anchor_date(df: DataFrame, as_of, deadline=C.DEADLINE, sop=C.SOP) -> DataFrame:
    """Date the visits lead up to, and where it came from."""
    date, source = ts(as_of), F.lit("now")
    for c, name in ((sop, "anlauf_sop"), (deadline, "rueckgabe_soll")):
        if c in df.columns:
            source = F.when(F.col(c).isNotNull(), F.lit(name)).otherwise(source)
            date = F.coalesce(F.col(c), date)
    return df.withColumns({"anchor": date, "anchor_source": source})


def backward_stagger(df: DataFrame, key: str, gaps: DataFrame, category: str, global_gap,
                     duration="predicted_duration_days", out="estimated_start") -> DataFrame:
    """start = anchor - duration - (last visit - visit) * gap of the category."""
    g = global_gap if isinstance(global_gap, Column) else F.lit(float(global_gap))
    g = F.coalesce(g, F.lit(float(C.DEFAULT_GAP_DAYS)))
    d = lookup(max_visit(df, key), gaps, category, category, "median_days", "__gap", g)
    back = F.col(duration) + (F.col("max_visit") - F.col("visit_number")) * F.col("__gap")
    return d.withColumn(out, add_days("anchor", -back)).drop("__gap")


def horizon_filter(df: DataFrame, as_of, months=C.HORIZON_MONTHS, start="estimated_start") -> DataFrame:
    """Visits starting between the month of ``as_of`` and ``months`` later (both included)."""
    i, now = month_index(start), month_index(ts(as_of))
    return (df.where((i >= now) & (i <= now + months))
            .withColumn("estimated_month", month_start(start)))


def row_calibration(df: DataFrame, factors: DataFrame, type_col="type", p="p", row_id="row_id",
                    lo=C.CAL_LO, hi=C.CAL_HI) -> DataFrame:
    """Fit the number of visits per type to its factor when that is outside [lo, hi].

    Below: the most likely max(1, round(n f)) rows stay. Above: the most likely rows appear
    twice, at most all of them. Types without a factor stay as they are. The rank inside a
    type comes from running counts over distinct probabilities, so a dominant type is not
    sorted in one task. Adds ``copy`` (0, or 1 for a duplicate).
    """
    df = materialize(df)  # read several times below
    cells = (df.where(F.col(p).isNotNull()).groupBy(type_col, p).agg(F.count(F.lit(1)).alias("n")))
    run = prefix_sums(cells, [type_col], p, ["n"], descending=True)
    f = factors.select(F.col("type").alias("__t"), F.col("factor").alias("__f"))
    n, above = F.col("tot_n"), F.col("cum_n") - F.col("n")
    target = F.greatest(F.lit(1), F.bround(n * F.col("__f"))).cast("long")
    wanted = F.when(target < n, target).otherwise(F.least(target - n, n))
    # one row per type that changes: the probability at the cut and how many of its rows are in
    cuts = (run.join(f, F.col(type_col) == F.col("__t")).where(~F.col("__f").between(lo, hi) & (target != n))
            .withColumn("__w", wanted).where((above < F.col("__w")) & (F.col("cum_n") >= F.col("__w")))
            .select("__t", F.col(p).alias("__cut"), (F.col("__w") - above).alias("__left"),
                    (target > n).alias("__dup")))
    cuts = materialize(cuts)
    d = df.join(cuts, F.col(type_col) == F.col("__t"), "left")
    tie = F.coalesce(F.col(p) == F.col("__cut"), F.lit(False))
    plain = d.where(~tie).withColumn("__in", F.col(p) > F.col("__cut"))
    both = plain.unionByName(_rank_ties(d.where(tie), type_col, row_id))
    one, two = F.array(F.lit(0).cast("long")), F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    kept = F.when(F.col(p).isNull() | F.col("__t").isNull(), one).when(
        F.col("__dup"), F.when(F.col("__in"), two).otherwise(one)).when(F.col("__in"), one)
    # explode drops rows without a copy list
    return both.select(*df.columns, F.explode(kept).alias("copy"))


def _rank_ties(tied: DataFrame, type_col: str, row_id: str) -> DataFrame:
    """Order the rows of the one tied cell per type by row id, range by range."""
    ids = tied.groupBy(type_col, row_id).agg(F.count(F.lit(1)).alias("__c"))
    run = prefix_sums(ids, [type_col], row_id, ["__c"]).select(
        F.col(type_col).alias("__jt"), F.col(row_id).alias("__ji"), F.col("cum___c").alias("__pos"))
    j = tied.join(run, (F.col(type_col) == F.col("__jt")) & (F.col(row_id) == F.col("__ji")))
    return j.withColumn("__in", F.col("__pos") <= F.col("__left")).drop("__jt", "__ji", "__pos")


def forecast_counts(df: DataFrame, as_of, month="estimated_month", type_col="type",
                    weight="calibration_weight") -> DataFrame:
    """Future month x type counts, raw and calibrated (sum of weights, half to even)."""
    d = df.where(month_index(month) >= month_index(ts(as_of)))
    return d.groupBy(month, type_col).agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.sum(weight)).cast("long").alias("n_calibrated"))


def forecast_pivot(df: DataFrame, as_of, types: list[str], month="estimated_month",
                   type_col="type", weight="calibration_weight") -> DataFrame:
    """Wide month x type counts with a total per month."""
    long = forecast_counts(df, as_of, month, type_col, weight)
    wide = long.groupBy(month).pivot(type_col, types).agg(F.sum("n")).fillna(0)
    total = sum((F.col(f"`{t}`") for t in types), F.lit(0))
    return wide.withColumn("total", total.cast("long"))


def blend_grid_search(df: DataFrame, y: str, model: str, type_median: str, ts_value: str | None = None,
                      step=0.1, min_rows=20) -> DataFrame:
    """Weights on a grid summing to one with the least MAE (first on ties); defaults on few rows."""
    n = int(round(1 / step))
    if ts_value is None:
        grid = [(i, round(i * step, 4), round(1 - i * step, 4), 0.0) for i in range(n + 1)]
    else:
        grid = []
        for a in range(n + 1):
            for b in range(n + 1 - a):
                grid.append((len(grid), round(a * step, 4), round(b * step, 4),
                             max(round(1 - a * step - b * step, 4), 0.0)))
    t = F.lit(0.0) if ts_value is None else F.col(ts_value)
    maes = [F.avg(F.abs(F.col(y) - (F.col(model) * wm + F.col(type_median) * wt + t * ws))).alias(f"__{i}")
            for i, wm, wt, ws in grid]
    one = df.agg(F.count(F.lit(1)).alias("n"), *maes)
    rows = F.array(*[F.struct(F.round(F.col(f"__{i}"), 9).alias("mae"), F.lit(i).alias("i"), F.lit(wm).alias("w_model"),
                              F.lit(wt).alias("w_type"), F.lit(ws).alias("w_ts")) for i, wm, wt, ws in grid])
    best = F.array_min(rows)
    dm, dt, dts = (C.BLEND_DUAL_MODEL, 1 - C.BLEND_DUAL_MODEL, 0.0) if ts_value is None else C.BLEND_TRIPLE
    few = F.col("n") < min_rows
    return one.select("n", F.when(few, F.lit(dm)).otherwise(best["w_model"]).alias("w_model"),
                      F.when(few, F.lit(dt)).otherwise(best["w_type"]).alias("w_type"),
                      F.when(few, F.lit(dts)).otherwise(best["w_ts"]).alias("w_ts"),
                      F.when(~few, best["mae"]).alias("mae"))


def duration_blend(model: str | None, type_median: str | None, overall, ts_value: str | None = None,
                   w_model=C.BLEND_DUAL_MODEL, w_ts=C.TS_WEIGHT) -> Column:
    """Predicted duration: triple or dual blend, down to whichever source exists."""
    o = overall if isinstance(overall, Column) else F.lit(overall).cast("double")
    if type_median is None:
        return F.col(model) if model is not None else o
    med = F.coalesce(F.col(type_median), o)
    if model is None:
        return med
    if ts_value is None:
        return F.lit(w_model) * F.col(model) + F.lit(1.0 - w_model) * med
    scale = 1.0 - w_ts
    return (F.lit(round(w_model * scale, 3)) * F.col(model)
            + F.lit(round((1.0 - w_model) * scale, 3)) * med + F.lit(w_ts) * F.col(ts_value))


def duration_by_group(df: DataFrame, group: str, value="predicted_duration_days") -> DataFrame:
    from visitgrid.plans.ordered import exact_quantiles
    d = df.where(F.col(group).isNotNull())
    base = d.groupBy(group).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"),
                                F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
                                F.max(value).alias("max"))
    return base.join(exact_quantiles(d, [group], value, {"median": 0.5}), group)


# -- backtest ------------------------------------------------------------------

def explode_types(df: DataFrame, package: str, out="type") -> DataFrame:
    return df.withColumn(out, F.explode(package_parts(package)))


def expected_counts(probs: DataFrame, k="k", cls="cls", p="p") -> DataFrame:
    """Expected visits per single type: K times probability, summed per class, then split."""
    per = probs.groupBy(cls).agg(F.sum(F.col(k) * F.col(p)).alias("__e"))
    return (per.select("__e", F.explode(package_parts(cls)).alias("type"))
            .groupBy("type").agg(F.sum("__e").alias("expected")))


def type_counts(df: DataFrame, package: str, name: str) -> DataFrame:
    """Rows per single type; the packages are counted before they are split."""
    per = df.where(F.col(package).isNotNull()).groupBy(package).agg(F.count(F.lit(1)).alias("__n"))
    return (per.select("__n", F.explode(package_parts(package)).alias("type"))
            .groupBy("type").agg(F.sum("__n").alias(name)))


def backtest_counts(actual: DataFrame, predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Per type and in total: counts, differences and percentages (one decimal).

    Inputs: (type, count_actual), (type, count_predicted), (type, expected).
    """
    e = expected.select("type", F.bround("expected").cast("long").alias("count_expected"))
    per = (actual.join(predicted, "type", "full_outer").join(e, "type", "left").fillna(0))
    d, x = F.col("count_predicted") - F.col("count_actual"), F.col("count_expected") - F.col("count_actual")
    per = per.select("type", "count_actual", "count_predicted", "count_expected",
                     d.alias("diff"), x.alias("exp_diff"))
    out = per.rollup("type").agg(*[F.sum(c).alias(c) for c in (
        "count_actual", "count_predicted", "count_expected", "diff", "exp_diff")],
        F.grouping("type").alias("__g"))
    base = F.when(F.col("__g") == 1, F.greatest("count_actual", F.lit(1))).otherwise(F.col("count_actual"))

    def pct(c):
        return F.bround(ratio(F.col(c) * 100.0, base), 1)

    return out.select(F.when(F.col("__g") == 1, F.lit("TOTAL")).otherwise(F.col("type")).alias("type"),
                      "count_actual", "count_predicted", "count_expected", "diff", pct("diff").alias("pct_diff"),
                      "exp_diff", pct("exp_diff").alias("exp_pct_diff"))


def calibration_factors(counts: DataFrame) -> DataFrame:
    """(type, factor): actual over predicted, 1 when nothing was predicted; no TOTAL row."""
    f = F.coalesce(F.bround(ratio("count_actual", "count_predicted"), 3), F.lit(1.0))
    return counts.where(F.col("type") != "TOTAL").select("type", f.alias("factor"))


def monthly_backtest(actual: DataFrame, predicted: DataFrame, factors: DataFrame, min_actual=50) -> DataFrame:
    """Actual, predicted and calibrated counts per type and month for types with enough visits.

    ``actual`` and ``predicted`` are (type, month) rows.
    """
    def counts(df, name):
        return df.where(F.col("month").isNotNull()).groupBy("type", "month").agg(F.count(F.lit(1)).alias(name))

    m = counts(actual, "actual").join(counts(predicted, "predicted"), ["type", "month"], "full_outer").fillna(0)
    keep = (actual.where(F.col("month").isNotNull()).groupBy("type").agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") >= min_actual).select("type"))
    m = m.join(keep, "type", "left_semi")
    m = lookup(m, factors, "type", "type", "factor", "__f", 1.0)
    return m.withColumn("calibrated", F.col("predicted") * F.col("__f")).drop("__f")


def export_table(history: DataFrame | None, forecast: DataFrame, base_columns: list[str], meta: dict,
                 direct: list[str] = (), renamed: dict[str, str] | None = None,
                 null_columns: list[str] = ()) -> DataFrame:
    """History rows and forecast rows in one canonical schema, with model metadata."""
    from visitgrid.operators.joins import union_history_forecast
    cols: dict[str, Column] = {}

    def source(name):
        if name in forecast.columns:
            return F.col(name)
        if f"{name}_clean" in forecast.columns:
            return F.col(f"{name}_clean")
        return F.lit(None).cast("string")

    for c in direct:
        cols[c] = source(c)
    for out, src in (renamed or {}).items():
        cols[out] = source(src)
    have = set(forecast.columns)
    start = F.col("estimated_start") if "estimated_start" in have else F.lit(None).cast("timestamp")
    cols[C.STATUS] = F.lit(C.FORECAST)
    cols[C.PACKAGE] = F.col("predicted_type") if "predicted_type" in have else F.lit(C.UNKNOWN)
    cols[C.START] = start
    cols[C.END] = (add_days(start, F.coalesce("predicted_duration_days", F.lit(0.0)))
                   if "predicted_duration_days" in have else F.lit(None).cast("timestamp"))
    for c in null_columns:
        cols[c] = F.lit(None).cast("string")
    for c, default in (("prob_coming", None), ("type_probability", None), ("calibration_weight", 1.0)):
        cols[c] = F.bround(c, 4) if c in have else F.lit(default).cast("double")
    cols["visit_number"] = F.col("visit_number") if "visit_number" in have else F.lit(1)
    cols["forecast_binary_approach"] = F.lit(meta.get("binary_approach", "unknown"))
    cols["forecast_binary_model"] = F.lit(meta.get("binary_model", "unknown"))
    cols["forecast_multiclass_model"] = F.lit(meta.get("multiclass_model", "N/A"))
    cols["forecast_duration_model"] = F.lit(meta.get("duration_model", "N/A"))
    cols["forecast_threshold"] = F.lit(round(float(meta.get("threshold", 0.5)), 4))
    cols["forecast_timestamp"] = F.date_format(ts(meta["as_of"]), "yyyy-MM-dd HH:mm:ss")
    fc = forecast.select(*[c.alias(n) for n, c in cols.items()])
    order = [*base_columns, *C.EXPORT_FORECAST_COLUMNS]
    if history is None:
        return union_history_forecast(fc.limit(0), fc, order)
    hist = history.select(*[c for c in base_columns if c in history.columns])
    return union_history_forecast(hist, fc, order)


def dashboard_totals(df: DataFrame, type_col="type", duration="predicted_duration_days") -> DataFrame:
    """Per type: visits, share in percent, duration quartiles."""
    from visitgrid.plans.ordered import exact_quantiles
    per = df.groupBy(type_col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    q = exact_quantiles(df, [type_col], duration, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return per.withColumn("share_pct", ratio(F.col("n") * 100.0, total)).join(q, type_col)
