"""Checks of a table against the declared limits; one pass plus a duplicate count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of the checks.
MAX_NULL_RATIO = 0.20
MAX_MEAN_DRIFT = 0.10
MIN_ROWS = 50


def validate_table(df: DataFrame, required: list[str], previous: DataFrame | None = None,
                   max_null=MAX_NULL_RATIO, max_drift=MAX_MEAN_DRIFT, min_rows=MIN_ROWS) -> DataFrame:
    """(check, subject, value, ok) for rows, required columns, null ratios, duplicates and drift."""
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.avg(F.col(c).isNull().cast("double")).alias(f"null_{i}") for i, c in enumerate(df.columns)]
    aggs += [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in nums]
    one = df.agg(*aggs)
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c"))
    one = one.withColumn("__dup", F.coalesce(distinct.agg(F.sum(F.col("__c") - 1)).scalar(), F.lit(0)))

    def row(check, subject, value, ok):
        return F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"),
                        value.cast("double").alias("value"), ok.cast("long").alias("ok"))

    rows = [row("min_rows", "table", F.col("__n"), F.col("__n") >= min_rows),
            row("duplicates", "table", F.col("__dup"), F.col("__dup") == 0)]
    rows += [row("required", c, F.lit(float(c in df.columns)), F.lit(c in df.columns)) for c in required]
    rows += [row("null_ratio", c, F.col(f"null_{i}"), F.col(f"null_{i}") <= max_null)
             for i, c in enumerate(df.columns)]
    if previous is not None:
        shared = [c for c in nums if c in previous.columns]
        before = previous.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in shared])).scalar()
        one = one.withColumn("__b", before)
        for c in shared:
            old = F.col(f"__b.{c}")
            shift = F.abs(F.col(f"mean_{c}") - old) / F.greatest(F.abs(old), F.lit(1e-9))
            rows.append(row("mean_drift", c, shift, F.coalesce(shift <= max_drift, F.lit(False))))
    return one.select(F.inline(F.array(*rows)))
