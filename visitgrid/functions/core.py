"""Column expressions used across operators. All are built-ins, so plans stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def ts(value) -> Column:
    """A timestamp literal or column; ``as_of`` is always explicit, never the wall clock."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def floor_days(end, start) -> Column:
    """Whole days between two timestamps, floored toward minus infinity."""
    micros = F.unix_micros(col(end)) - F.unix_micros(col(start))
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("long")


def month_start(c) -> Column:
    return F.date_trunc("month", col(c))


def month_index(c) -> Column:
    """Months since year 0: adjacent calendar months differ by one."""
    return (F.year(col(c)) * 12 + F.month(col(c))).cast("long")


def add_days(c, days) -> Column:
    """Add fractional days to a timestamp (microsecond resolution)."""
    return F.timestamp_micros(
        F.unix_micros(col(c)) + F.round(col(days) * F.lit(MICROS_PER_DAY)).cast("long"))


def md5_int(c) -> Column:
    """A reproducible 32-bit integer from any value; the only randomness used in plans."""
    return F.conv(F.substring(F.md5(col(c).cast("string")), 1, 8), 16, 10).cast("long")


def md5_unit(c) -> Column:
    """A reproducible number in (0, 1)."""
    return (md5_int(c) + F.lit(0.5)) / F.lit(4294967296.0)


def or_unknown(c, default="UNKNOWN") -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(default))


def cut(value, edges, labels, right=True) -> Column:
    """Bucket a number by edges; outside every interval gives null.

    ``right`` closes intervals on the right, otherwise on the left.
    """
    v = col(value)
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        if right:
            inside = (v > F.lit(float(lo))) & (v <= F.lit(float(hi)))
        else:
            inside = (v >= F.lit(float(lo))) & (v < F.lit(float(hi)))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def ratio(num, den, default=None) -> Column:
    """num / den, with ``default`` (else null) where the denominator is zero or null."""
    out = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def r6(c) -> Column:
    """Round to six places; adding zero turns a negative zero into zero."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def general_format(c, digits=4) -> Column:
    """Format a double with ``digits`` significant digits and no trailing zeros (like ``%.4g``)."""
    v = col(c).cast("double")
    exponent = F.floor(F.log10(F.abs(v)))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1.0) - exponent)
    rounded = F.when(v == 0, F.lit(0.0)).otherwise(F.bround(v * scale) / scale)
    text = F.format_string(f"%.{digits}g", rounded)
    stripped = F.regexp_replace(text, r"(\.\d*?)0+($|e)", "$1$2")
    return F.when(v == 0, F.lit("0")).otherwise(F.regexp_replace(stripped, r"\.($|e)", "$1"))


def package_parts(c) -> Column:
    """A comma-joined package as an array of trimmed, non-blank single types."""
    parts = F.transform(F.split(col(c), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & (p != "<NA>"))


def calendar_parts(date: str) -> dict[str, Column]:
    """Month, quarter, year, weekday (Monday = 0) and ISO week."""
    d = F.col(date)
    return {"month": F.month(d), "quarter": F.quarter(d), "year": F.year(d),
            "day_of_week": F.weekday(d), "week_of_year": F.weekofyear(d)}
