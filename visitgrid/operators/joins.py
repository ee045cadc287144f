"""Joins. No broadcast is forced: Spark broadcasts a side only when its measured size is below
spark.sql.autoBroadcastJoinThreshold, else it shuffles and splits skewed keys (adaptive)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgrid import columns as C
from visitgrid.functions.core import month_index, month_start


def label_semi_join(entities: DataFrame, visits: DataFrame, key=C.JOIN_KEY, label=C.LABEL) -> DataFrame:
    """Every entity once, with 1 where its key occurs among the visits (null key: 0)."""
    keys = visits.where(F.col(key).isNotNull()).select(F.col(key).alias("__k")).distinct()
    joined = entities.join(keys, F.col(key) == F.col("__k"), "left")
    return joined.select(*entities.columns, F.col("__k").isNotNull().cast("long").alias(label))


def inner_join_coalesce(visits: DataFrame, entities: DataFrame, key=C.JOIN_KEY) -> DataFrame:
    """Many-to-many equi-join; shared columns take the visit value, else the entity value."""
    a = visits.where(F.col(key).isNotNull()).alias("a")
    b = entities.where(F.col(key).isNotNull()).alias("b")
    shared = [c for c in visits.columns if c in entities.columns and c != key]
    cols: list[Column] = [F.col(f"a.{key}").alias(key)]
    for c in visits.columns:
        if c in shared:
            cols.append(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c))
        elif c != key:
            cols.append(F.col(f"a.{c}"))
    cols += [F.col(f"b.{c}") for c in entities.columns if c != key and c not in shared]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(*cols)


def keep_columns(df: DataFrame, allowed: Iterable[str], extra: Iterable[str] = ()) -> DataFrame:
    """Allow-list projection between stages (a guard against leakage)."""
    allowed = set(allowed) | set(extra)
    return df.select(*[c for c in df.columns if c in allowed])


def nearest_month_value(df: DataFrame, date: str, forecast: DataFrame, month="month",
                        value="value", out="ts_value") -> DataFrame:
    """The forecast value of the nearest month (ties to the later one); mean where undated.

    Distinct months of the table and the forecast months are merged into one ordered list
    (at most one row per calendar month, so one window task is enough); each month looks to
    its nearest earlier and later forecast, and the result joins back by month.
    """
    mean = forecast.agg(F.avg(value)).scalar()
    points = forecast.select(month_index(month).alias("__i"), F.col(value).cast("double").alias("__v"))
    months = df.where(F.col(date).isNotNull()).select(month_index(date).alias("__i")).distinct()
    line = months.withColumn("__v", F.lit(None).cast("double")).unionByName(points)
    line = line.groupBy("__i").agg(F.max("__v").alias("__v"))
    point = F.when(F.col("__v").isNotNull(), F.struct("__i", "__v"))
    back = Window.orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.orderBy("__i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    prev, nxt = F.last(point, True).over(back), F.first(point, True).over(ahead)
    ends = line.select("__i", prev.alias("p"), nxt.alias("n"))
    later = (F.col("p").isNull()
             | (F.col("n.__i") - F.col("__i") <= F.col("__i") - F.col("p.__i")))
    near = ends.select(F.col("__i").alias("__m"), F.when(
        later & F.col("n").isNotNull(), F.col("n.__v")).otherwise(F.col("p.__v")).alias("__near"))
    joined = df.join(near, month_index(date) == F.col("__m"), "left")
    return joined.select(*df.columns, F.coalesce("__near", mean).alias(out))


def outer_join_counts(actual: DataFrame, predicted: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join of two count tables; absent counts are 0."""
    return actual.join(predicted, on, "full_outer").fillna(0)


def first_visit_month(visits: DataFrame, key=C.JOIN_KEY, start=C.START, order=None) -> DataFrame:
    """Month of the first row per key (by ``order``, else by visit time)."""
    by = F.struct(*[F.col(c) for c in ([order] if order else [start])])
    return (visits.where(F.col(key).isNotNull())
            .groupBy(key).agg(F.min_by(F.col(start), by).alias("__s"))
            .select(key, month_start("__s").alias("month")))


def union_history_forecast(history: DataFrame, forecast: DataFrame, columns: list[str]) -> DataFrame:
    """Both row sets in one column order; missing columns become null."""
    both = history.unionByName(forecast, allowMissingColumns=True)
    return both.select(*[F.col(c) if c in both.columns else F.lit(None).cast("string").alias(c)
                         for c in columns])


def split_known(df: DataFrame, column: str, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose value occurs in ``known``, and the others (nulls included)."""
    k = known.select(F.col(key).alias("__k")).distinct()
    cond = F.col(column) == F.col("__k")
    return df.join(k, cond, "left_semi"), df.join(k, cond, "left_anti")
