"""The whole engineered feature set of a merged table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from visitgrid.operators import aggregates as A
from visitgrid.operators import cleanse as K


def _either(df: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in df.columns), None)


def engineer_features(df: DataFrame, as_of, clean: bool = True) -> DataFrame:
    """Ages, buckets, crosses, group sizes, shares, deadline and product columns that apply."""
    df = K.recency_flags(K.age_buckets(K.age_months(df, as_of)))
    df = K.category_cross(df)
    motor = _either(df, "motortyp", "motortype")
    stage = _either(df, "istufe", "current_istufe")
    sizes = {"derivat": "derivat_fleet_size", "pl": "pl_fleet_size",
             "puk_werk": "puk_werk_fleet_size", "bo": "bo_fleet_size"}
    shares = {"derivat": "derivat_freq", "basistyp": "basistyp_freq", "bo": "bo_freq",
              "puk_werk": "puk_werk_freq"}
    if motor:
        sizes[motor], shares[motor] = "motortyp_fleet_size", "motortyp_freq"
    if stage:
        shares[stage] = "istufe_freq"
    # one pass over the table fits every group size; the joins below read that small table
    counts = A.value_counts(df, [c for c in {**sizes, **shares} if c in df.columns])
    if "derivat" in df.columns:
        df = A.common_flag(df, "derivat", "is_common_derivat", counts)
    df = A.fleet_size(df, sizes, counts)
    df = K.deadline_features(df, as_of)
    df = A.frequency_feature(df, shares, counts)
    df = K.numeric_interactions(df)
    return K.clean_categoricals(df) if clean else df
