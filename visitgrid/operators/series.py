"""Monthly demand forecasters for many series at once.

A series is at most one row per calendar month, so its ordered array is short by nature;
every forecaster is a fold over that array and the job spreads over the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgrid.functions.core import ratio
from visitgrid.operators.regression import regression_metrics

SEASON = 12


def to_arrays(df: DataFrame, by, month="month", value="y", out="ys") -> DataFrame:
    """One row per series with its values in month order (and the last month)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(month).alias("m"), F.col(value).cast("double").alias("v"))))
    g = df.groupBy(*by).agg(pairs.alias("__p"), F.max(month).alias("last_month"))
    return g.select(*by, F.transform("__p", lambda p: p["v"]).alias(out), "last_month")


def lag_features(df: DataFrame, by, n_lags: int, month="month", value="y") -> DataFrame:
    """lag_1..lag_n per month; months without a full history are dropped."""
    w = Window.partitionBy(*by).orderBy(month)
    out = df.select("*", *[F.lag(value, i).over(w).alias(f"lag_{i}") for i in range(1, n_lags + 1)])
    return out.where(F.col(f"lag_{n_lags}").isNotNull())


def sliding_windows(df: DataFrame, by, seq_len=12, pred_len=3, month="month", value="y") -> DataFrame:
    """Every (seq_len history, pred_len future) pair of a series."""
    w = Window.partitionBy(*by).orderBy(month)
    x = F.collect_list(value).over(w.rowsBetween(-seq_len + 1, 0))
    y = F.collect_list(value).over(w.rowsBetween(1, pred_len))
    out = df.select(*by, month, x.alias("x"), y.alias("y_next"))
    return out.where((F.size("x") == seq_len) & (F.size("y_next") == pred_len))


def autocorrelation(df: DataFrame, by, max_lag=24, month="month", value="y") -> DataFrame:
    """Pearson correlation of a series with itself k months earlier, k = 1..min(24, n - 1)."""
    w = Window.partitionBy(*by).orderBy(month)
    lagged = df.select(*by, F.col(value).alias("__y"),
                       F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("__n"),
                       *[F.lag(value, k).over(w).alias(f"__{k}") for k in range(1, max_lag + 1)])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"__{k}").alias("v"))
                     for k in range(1, max_lag + 1)])
    long = lagged.select(*by, "__y", "__n", F.inline(rows))
    return (long.where((F.col("lag") <= F.col("__n") - 1) & F.col("v").isNotNull())
            .groupBy(*by, "lag").agg(F.corr("__y", "v").alias("acf")))


def demand_class(df: DataFrame, by, month="month", value="n") -> DataFrame:
    """Smooth / Erratic / Intermittent / Lumpy from the mean gap of non-zero months and CV2."""
    whole = Window.partitionBy(*by)
    pos = df.withColumn("__i", F.row_number().over(whole.orderBy(month)))
    nz = pos.where(F.col(value) > 0)
    nz = nz.withColumn("__gap", F.col("__i") - F.lag("__i").over(whole.orderBy(month)))
    s = nz.groupBy(*by).agg(F.avg("__gap").alias("adi"), F.count(F.lit(1)).alias("n_nonzero"),
                            F.pow(ratio(F.stddev_samp(value), F.avg(value)), F.lit(2.0)).alias("cv2"))
    every = df.select(*by).distinct()
    s = every.join(s, list(by), "left").fillna({"n_nonzero": 0})
    steady, even = F.col("adi") < 1.32, F.col("cv2") < 0.49
    cls = (F.when(F.col("n_nonzero") < 2, F.lit("Lumpy"))
           .when(steady & even, F.lit("Smooth")).when(steady, F.lit("Erratic"))
           .when(even, F.lit("Intermittent")).otherwise(F.lit("Lumpy")))
    return s.select(*by, "n_nonzero", "adi", "cv2", cls.alias("demand_class"))


# -- forecasters: array in, array of h values out ------------------------------

def _mean(a) -> Column:
    return ratio(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def _steps(h: int) -> Column:
    return F.sequence(F.lit(1), F.lit(h))


def _flat(v, h: int) -> Column:
    return F.transform(_steps(h), lambda _: v)


def sma(ys, h: int, window=3) -> Column:
    """Recursive mean of the last ``window`` values; forecasts join the history."""
    y = F.col(ys) if isinstance(ys, str) else ys
    grown = F.aggregate(_steps(h), y, lambda a, _: F.concat(
        a, F.array(_mean(F.slice(a, F.greatest(F.size(a) - window + 1, F.lit(1)), window)))))
    return F.slice(grown, F.size(y) + 1, h)


def ses(ys, h: int, alpha=0.3) -> Column:
    """Simple exponential smoothing from the first value; flat."""
    y = F.col(ys) if isinstance(ys, str) else ys
    level = F.aggregate(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), F.get(y, F.lit(0)),
                        lambda s, x: F.lit(alpha) * x + F.lit(1 - alpha) * s)
    return _flat(level, h)


def croston(ys, h: int, alpha=0.1) -> Column:
    """Smoothed non-zero demand over smoothed gap; flat and not negative."""
    y = F.col(ys) if isinstance(ys, str) else ys
    first = F.coalesce(F.get(F.filter(y, lambda v: v > 0), F.lit(0)), F.lit(0.0))
    start = F.struct(first.alias("q"), F.lit(1.0).alias("a"), F.lit(0.0).alias("since"))

    def step(s, v):
        since = s["since"] + 1.0
        q = F.lit(alpha) * v + F.lit(1 - alpha) * s["q"]
        a = F.lit(alpha) * since + F.lit(1 - alpha) * s["a"]
        return F.struct(F.when(v > 0, q).otherwise(s["q"]).alias("q"),
                        F.when(v > 0, a).otherwise(s["a"]).alias("a"),
                        F.when(v > 0, F.lit(0.0)).otherwise(since).alias("since"))

    end = F.aggregate(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), start, step)
    value = F.greatest(ratio(end["q"], end["a"], 0), F.lit(0.0))
    return _flat(F.when(F.size(y) < 2, F.coalesce(_mean(y), F.lit(0.0))).otherwise(value), h)


def sba(ys, h: int, alpha=0.1) -> Column:
    """Bias-corrected Croston."""
    return F.transform(croston(ys, h, alpha), lambda v: v * F.lit(1 - alpha / 2))


# Smoothing parameters tried for Holt-Winters.
HW_GRID = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.05, 0.2) for g in (0.1, 0.3)]


def holt_winters_fold(ys, seasonal: bool, alpha, beta, gamma) -> Column:
    """Struct (level, trend, season[12], i, sse) after one pass with additive updates."""
    y = F.col(ys) if isinstance(ys, str) else ys
    if seasonal:
        first, second = _mean(F.slice(y, 1, SEASON)), _mean(F.slice(y, SEASON + 1, SEASON))
        season = F.transform(F.slice(y, 1, SEASON), lambda v: v - first)
        level, trend = first, (second - first) / SEASON
        rest = F.slice(y, SEASON + 1, F.greatest(F.size(y) - SEASON, F.lit(0)))
    else:
        level, trend = F.get(y, F.lit(0)), F.get(y, F.lit(1)) - F.get(y, F.lit(0))
        season = F.array(F.lit(0.0))
        rest = F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0)))
    start = F.struct(level.alias("l"), trend.alias("t"), season.alias("s"), F.lit(0.0).alias("e"))

    def step(s, v):
        # the oldest seasonal term sits first and goes to the back after use
        old = F.get(s["s"], F.lit(0)) if seasonal else F.lit(0.0)
        fit = s["l"] + s["t"] + old
        l2 = alpha * (v - old) + (1 - alpha) * (s["l"] + s["t"])
        t2 = beta * (l2 - s["l"]) + (1 - beta) * s["t"]
        if seasonal:
            new = gamma * (v - l2) + (1 - gamma) * old
            ring = F.concat(F.slice(s["s"], 2, SEASON - 1), F.array(new))
        else:
            ring = s["s"]
        return F.struct(l2.alias("l"), t2.alias("t"), ring.alias("s"),
                        (s["e"] + (v - fit) * (v - fit)).alias("e"))

    return F.aggregate(rest, start, step)


def _hw_forecast(end, h: int, seasonal: bool) -> Column:
    def at(k):
        base = end["l"] + k.cast("double") * end["t"]
        term = F.get(end["s"], (k - 1) % SEASON) if seasonal else F.lit(0.0)
        return F.greatest(base + term, F.lit(0.0))
    return F.transform(_steps(h), at)


def holt_winters(df: DataFrame, by, ys: str, h: int, grid=None, out="fc") -> DataFrame:
    """Additive trend, plus season when 24 months exist; the grid point with the least squared
    one-step error wins (first on ties). Series with fewer than two months give null."""
    grid = list(HW_GRID if grid is None else grid)
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"),
                                F.lit(g).alias("g")) for i, (a, b, g) in enumerate(grid)])
    trial = df.select(*by, ys, F.explode(points).alias("p"))
    p = F.col("p")
    long, short = F.size(ys) >= 2 * SEASON, F.size(ys) >= 2
    e_s = holt_winters_fold(ys, True, p["a"], p["b"], p["g"])
    e_t = holt_winters_fold(ys, False, p["a"], p["b"], p["g"])
    fitted = trial.select(*by, p["i"].alias("i"),
                          F.when(long, e_s).alias("es"), F.when(short & ~long, e_t).alias("et"))
    scored = fitted.select(
        *by, "i", F.coalesce(F.col("es.e"), F.col("et.e")).alias("sse"),
        F.coalesce(F.when(F.col("es").isNotNull(), _hw_forecast(F.col("es"), h, True)),
                   F.when(F.col("et").isNotNull(), _hw_forecast(F.col("et"), h, False))).alias("fc"))
    best = scored.groupBy(*by).agg(F.min_by("fc", F.struct("sse", "i")).alias(out))
    return df.join(best, list(by), "left")


MODELS = ("SMA(3)", "SMA(6)", "SES", "ETS(add)", "Croston", "SBA")


def all_forecasts(arrays: DataFrame, by, ys: str, h: int) -> DataFrame:
    """(by, model, fc) for every classical model."""
    d = holt_winters(arrays, by, ys, h, out="__hw")
    rows = F.array(*[F.struct(F.lit(m).alias("model"), f.alias("fc")) for m, f in (
        ("SMA(3)", sma(ys, h, 3)), ("SMA(6)", sma(ys, h, 6)), ("SES", ses(ys, h)),
        ("ETS(add)", F.col("__hw")), ("Croston", croston(ys, h)), ("SBA", sba(ys, h)))])
    return d.select(*by, F.inline(rows)).where(F.col("fc").isNotNull())


def ts_benchmark(df: DataFrame, by, month="month", value="y", share=0.8, min_months=12) -> DataFrame:
    """MAE, RMSE, R2 and rank of each model on each series' last 20 % of months."""
    arrays = to_arrays(df, by, month, value).where(F.size("ys") >= min_months)
    split = F.greatest(F.floor(F.size("ys") * F.lit(share)), F.lit(6)).cast("int")
    a = arrays.select(*by, F.slice("ys", 1, split).alias("train"),
                      F.slice("ys", split + 1, F.size("ys")).alias("test"))
    a = a.where(F.size("test") >= 1)
    # every forecast is made for the longest test span and cut to the series' own
    h = a.agg(F.max(F.size("test"))).first()[0] or 1
    fc = all_forecasts(a.select(*by, "train"), by, "train", int(h))
    pairs = fc.join(a.select(*by, "test"), list(by)).select(
        *by, "model", F.explode(F.arrays_zip(
            F.col("test").alias("y"), F.slice("fc", 1, F.size("test")).alias("p"))).alias("z"))
    m = regression_metrics(pairs.select(*by, "model", F.col("z")["y"].alias("y"), F.col("z")["p"].alias("p")),
                           "y", "p", [*by, "model"])
    w = Window.partitionBy(*by).orderBy("mae", "model")
    return m.withColumn("rank", F.row_number().over(w).cast("long"))


def forecast_best(df: DataFrame, by, bench: DataFrame, h=18, month="month", value="y") -> DataFrame:
    """The best-ranked model of each series refitted on all months, h months ahead."""
    arrays = to_arrays(df, by, month, value)
    best = bench.where(F.col("rank") == 1).select(*by, "model")
    fc = all_forecasts(arrays, by, "ys", h).join(best, [*by, "model"])
    fc = fc.join(arrays.select(*by, "last_month"), list(by))
    out = fc.select(*by, "model", "last_month", F.posexplode("fc").alias("i", "value"))
    return out.select(*by, "model", F.add_months("last_month", F.col("i") + 1).cast("timestamp").alias("month"),
                      "value")


def ts_unified_ranking(tables: DataFrame, by) -> DataFrame:
    """All models by MAE plus one row averaging the metrics of the three best.

    ``tables``: (by, model, family, mae, rmse, r2); one row per model and series.
    """
    w = Window.partitionBy(*by).orderBy("mae", "model")
    top = tables.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 3)
    ens = top.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.avg("mae").alias("mae"),
                               F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"))
    ens = ens.where(F.col("__n") == 3).select(*by, F.lit("Ensemble(top3)").alias("model"),
                                              F.lit("Ensemble").alias("family"), "mae", "rmse", "r2")
    both = tables.select(*by, "model", "family", "mae", "rmse", "r2").unionByName(ens)
    return both.withColumn("rank", F.row_number().over(w).cast("long"))


def naive_flat_baseline(df: DataFrame, type_col: str, date: str, as_of, months=18) -> DataFrame:
    """Mean monthly count per type over the whole history, rounded half to even, repeated."""
    from visitgrid.functions.core import month_start, ts
    d = df.where(F.col(date).isNotNull() & F.col(type_col).isNotNull())
    cells = d.groupBy(F.col(type_col).alias("type"), month_start(date).alias("m")).agg(
        F.count(F.lit(1)).alias("n"))
    span = cells.agg(F.count_distinct("m")).scalar()
    avg = cells.groupBy("type").agg(F.sum("n").alias("__n")).select(
        "type", ratio("__n", span).alias("avg_per_month"))
    grid = F.sequence(month_start(ts(as_of)), F.add_months(month_start(ts(as_of)), months - 1).cast("timestamp"),
                      F.expr("interval 1 month"))
    return avg.select("type", "avg_per_month", F.explode(grid).alias("month"),
                      F.bround("avg_per_month").cast("long").alias("n"))


def ts_quality_gate(bench: DataFrame, overall_median, min_r2=0.0, max_rel_mae=0.5) -> DataFrame:
    """1 where the best model beats the mean and its MAE is below half the median target."""
    m = overall_median if isinstance(overall_median, Column) else F.lit(float(overall_median))
    rel = F.col("mae") / F.greatest(F.abs(m), F.lit(1e-6))
    ok = (F.col("r2") > min_r2) & (rel < max_rel_mae)
    return bench.where(F.col("rank") == 1).withColumns(
        {"rel_mae": rel, "usable": F.coalesce(ok, F.lit(False)).cast("long")})
