"""Row-to-text, prompt assembly and answer parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitgrid.functions.core import general_format


def _value_text(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    v = F.col(c)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
        return F.when(finite, general_format(v)).otherwise(F.lit("NA"))
    return F.coalesce(v.cast("string"), F.lit("NA"))


def row_to_text(df: DataFrame, cols: list[str]) -> Column:
    """``a=1; b=x``: floats with four significant digits, missing as NA."""
    return F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), _value_text(df, c)) for c in cols])


def row_to_lines(df: DataFrame, cols: list[str]) -> Column:
    """One ``  a = 1`` line per column."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"  {c} = "), _value_text(df, c)) for c in cols])


def text_to_lines(text) -> Column:
    """Turn ``a=1; b=x`` text into one ``  a = 1`` line per part."""
    return F.array_join(F.transform(
        F.split(text, "; "),
        lambda p: F.concat(F.lit("  "), F.regexp_replace(p, "^([^=]*)=", "$1 = "))), "\n")


#: How a column is described by its role.
ROLE_TEXT = {"number": "a measured number", "category": "one of several named values",
             "share": "how common the row's value is", "encoding": "the mean label of the row's value"}


def feature_glossary(roles: list[tuple[str, str]]) -> str:
    """One line per (feature, role)."""
    return "\n".join(f"- {name}: {ROLE_TEXT[role]}" for name, role in roles)


def assemble_prompt(task: str, sections: list[tuple[str, object]]) -> Column:
    """A task followed by titled sections, each a string or a column."""
    pieces: list[Column] = [F.lit(task)]
    for title, part in sections:
        pieces += [F.lit(f"\n\n[{title}]\n"), F.lit(part) if isinstance(part, str) else part]
    return F.concat(*pieces)


def strip_fences(text) -> Column:
    """Remove a surrounding code fence, if any."""
    t = F.trim(text)
    inner = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*?)```[^`]*$", 1)
    return F.when(t.startswith("```"), F.trim(inner)).otherwise(t)


def parse_binary_answer(text) -> dict[str, Column]:
    """probability (clipped, 0.5 if unreadable), prediction (0 if unreadable), explanation."""
    js = F.from_json(strip_fences(text),
                     "probability double, prediction long, explanation string, reasoning string")
    p = F.coalesce(js["probability"], F.lit(0.5))
    return {"probability": F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)),
            "prediction": F.coalesce(js["prediction"], F.lit(0)).cast("long"),
            "explanation": F.coalesce(js["explanation"], F.lit(""))}


def parse_class_answer(text, classes: list[str]) -> Column:
    """Class probabilities as an array in class order, renormalised; uniform if none is usable."""
    js = F.from_json(strip_fences(text), "predictions map<string,double>")
    raw = F.array(*[F.coalesce(F.try_element_at(js["predictions"], F.lit(c)), F.lit(0.0))
                    for c in classes])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    even = F.array(*[F.lit(1.0 / len(classes))] * len(classes))
    return F.when(total > 0, F.transform(raw, lambda x: x / total)).otherwise(even)


def parse_number_list(text, horizon: int) -> Column:
    """A JSON array, else the first bracketed run of numbers, else all numbers when enough."""
    body = strip_fences(text)
    whole = F.from_json(body, "array<double>", {"mode": "PERMISSIVE"})
    whole = F.when(F.exists(whole, lambda x: x.isNull()), F.lit(None)).otherwise(whole)
    run = F.regexp_extract(body, r"\[[\d\s.,\-eE+]+\]", 0)
    bracket = F.from_json(F.when(run != "", run), "array<double>")
    bracket = F.when(F.exists(bracket, lambda x: x.isNull()), F.lit(None)).otherwise(bracket)
    found = F.transform(F.regexp_extract_all(body, F.lit(r"([\-+]?\d+\.?\d*(?:[eE][\-+]?\d+)?)"), 1),
                        lambda x: x.cast("double"))
    loose = F.when(F.size(found) >= horizon, found)
    return F.slice(F.coalesce(whole, bracket, loose), 1, horizon)
