"""Regression on lagged values, per series: walk-forward errors and recursive forecasts.

A series is at most one row per month, so all its folds fit in one row of arrays. Tasks solve the
normal equations of every fold of their series; there is no loop over folds or series elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid.operators.series import to_arrays

KINDS = ("LinearReg", "Ridge", "Lasso")
#: Penalties of ridge and lasso, sweeps of the lasso.
RIDGE, LASSO, SWEEPS = 1.0, 0.01, 3000


def lags_for(months: int) -> int:
    """Lags that a series of so many months is given: a fifth of them, 3 to 6."""
    return min(6, max(3, months // 5))


def folds_of(n: int, n_lags: int) -> list[tuple[int, int]]:
    """(train end, test end) of expanding windows over n rows; the rest after the last full block is
    a block of its own."""
    first, size = max(n_lags + 2, n // 3), max(1, n // 6)
    count = max(1, (n - first) // size)
    full = [(first + k * size, first + (k + 1) * size) for k in range(count) if first + (k + 1) * size <= n]
    if not full:
        return [(first, n)]
    return full + ([(full[-1][1], n)] if full[-1][1] < n else [])


def lagged(ys: np.ndarray, n_lags: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lags) with lag 1 first, and the values they precede."""
    windows = np.lib.stride_tricks.sliding_window_view(ys, n_lags + 1)
    return windows[:, -2::-1], windows[:, -1]


def fitted(x: np.ndarray, y: np.ndarray, kind: str):
    """(weights, intercept) on min-max scaled columns, for values of the original scale."""
    low, span = x.min(axis=0), np.ptp(x, axis=0)
    scaled = (x - low) / np.where(span == 0, 1, span)
    mx, my = scaled.mean(axis=0), y.mean()
    c, t = scaled - mx, y - my
    if kind == "Lasso":
        w, left, norms = np.zeros(c.shape[1]), t.copy(), (c * c).sum(axis=0)
        for _ in range(SWEEPS):
            before = w.copy()
            for j in np.flatnonzero(norms > 0):
                rho = c[:, j] @ left + norms[j] * w[j]
                new = np.sign(rho) * max(abs(rho) - LASSO * len(y), 0) / norms[j]
                left += c[:, j] * (w[j] - new)
                w[j] = new
            if np.abs(w - before).max(initial=0) <= 1e-10 * max(np.abs(w).max(initial=0), 1):
                break
    elif kind == "Ridge":
        w = np.linalg.solve(c.T @ c + RIDGE * np.eye(c.shape[1]), c.T @ t)
    else:
        w = np.linalg.lstsq(c, t, rcond=None)[0]
    w = w / np.where(span == 0, 1, span)
    return w, my - mx @ (w * np.where(span == 0, 1, span)) - low @ w


def _fold_errors(ys: np.ndarray, n_lags: int, kind: str):
    """Means over folds of MAE, RMSE and R2 (folds of constant values have none), and the folds."""
    x, y = lagged(ys, n_lags)
    rows = []
    for a, b in folds_of(len(y), n_lags):
        w, b0 = fitted(x[:a], y[:a], kind)
        e = y[a:b] - np.maximum(x[a:b] @ w + b0, 0)
        spread = ((y[a:b] - y[a:b].mean()) ** 2).sum()
        rows.append((np.abs(e).mean(), np.sqrt((e * e).mean()), 1 - (e * e).sum() / spread if spread else np.nan))
    mae, rmse, r2 = np.array(rows).T
    return mae.mean(), rmse.mean(), np.nanmean(r2) if np.isfinite(r2).any() else None, len(rows)


def _arrays(df: DataFrame, by, month, value, least: int) -> DataFrame:
    return to_arrays(df, by, month, value).where(F.size("ys") >= least)


def lag_benchmark(df: DataFrame, by, kinds=KINDS, n_lags: int | None = None, month="month", value="y") -> DataFrame:
    """(by, model, family, mae, rmse, r2, folds) of every kind and series, means over the folds.

    Series need six months more than lags (``lags_for`` of their length, unless given).
    """
    by, kinds = list(by), list(kinds)
    arrays = _arrays(df, by, month, value, (n_lags or 3) + 6).select(*by, "ys")
    types = dict(arrays.dtypes)

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, ys in enumerate(batch.column("ys").to_pylist()):
                ys = np.array(ys, dtype=float)
                lags = n_lags or lags_for(len(ys))
                if len(ys) >= lags + 6:
                    at += [i] * len(kinds)
                    rows += [(f"Lag-{k}", "ML on Lags", *_fold_errors(ys, lags, k)) for k in kinds]
            names = ["model", "family", "mae", "rmse", "r2", "folds"]
            kinds_ = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(at, pa.int64())) for c in by),
                 *(pa.array(list(c), t) for c, t in zip(cols, kinds_))], names=[*by, *names])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "model string, family string, mae double, rmse double, r2 double, folds long"])
    return arrays.mapInArrow(run, schema)


def lag_forecast(df: DataFrame, by, h: int, kind="Ridge", n_lags: int | None = None, month="month", value="y") -> DataFrame:
    """(by, month, value): the model of all months, fed its own forecasts, h months ahead, not negative."""
    by = list(by)
    arrays = _arrays(df, by, month, value, (n_lags or 3) + 2)
    types = dict(arrays.dtypes)

    def run(batches):
        for batch in batches:
            out = []
            for ys in batch.column("ys").to_pylist():
                ys = np.array(ys, dtype=float)
                lags = min(n_lags or lags_for(len(ys)), len(ys) - 2)
                w, b0 = fitted(*lagged(ys, lags), kind)
                for _ in range(h):
                    ys = np.append(ys, max(ys[:-lags - 1:-1] @ w + b0, 0))
                out.append(ys[-h:] if h else ys[:0])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in [*by, "last_month"]), pa.array(out, pa.list_(pa.float64()))], names=[*by, "last_month", "fc"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), f"last_month {types['last_month']}", "fc array<double>"])
    out = arrays.select(*by, "ys", "last_month").mapInArrow(run, schema).select(*by, "last_month", F.posexplode("fc").alias("i", "value"))
    return out.select(*by, F.add_months("last_month", F.col("i") + 1).cast("timestamp").alias("month"), "value")
