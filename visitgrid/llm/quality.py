"""Quality rules with adaptive thresholds.

Fixed cutoffs are replaced by fences read from quantile sketches per language and source. A
sketch is a set of counts over log-linear integer buckets, so sketches merge by adding counts:
in any order, over any split of the rows, with the same result. Groups with few documents use
the merged sketch of their language, and small languages that of the corpus.

Defined cases: a null or empty text has no words and fails the base rule. Null languages and
sources form groups of their own. Repeated rows are judged each for itself. An empty table gives
an empty result. Columns that the operator does not need are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgrid.llm.common import DOCUMENT_COLUMNS, raw_bytes
from visitgrid.plans.ordered import materialize

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PCT = 30

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo_words")
#: Rates in thousandths: name -> (numerator, denominator, slack added to the fence, two-sided).
RATES = {
    "symbol_rate": ("n_symbols", "n_words", 100, False),
    "dup_line_rate": ("n_dup_lines", "n_lines", 100, False),
    "repeat_rate": ("n_repeat_words", "n_words", 50, False),
    "echo_rate": ("n_echo_words", "n_words", 50, False),
    "mean_chars": ("word_chars", "n_words", 1500, True),
}
#: Rates that are 0 in most documents, so that their quartiles say nothing: the fence lies at twice this
#: percentage of the rows at least. (Junk makes up more of the rows with symbols: no such fence there.)
TOP = {"dup_line_rate": 99, "repeat_rate": 99}
#: A group's own sketch decides from this many documents on.
MIN_GROUP = 100
#: Fences lie this many interquartile ranges outside the quartiles.
REACH = 3


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside ``window``-word windows that occur twice or more (window a power of two).

    Window ids come from pairing the ids of two half windows, so equal ids mean equal words.
    """
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    step, counts = 1, None
    while step < window:
        pairs = ids[:-step] * (ids.max() + 1) + ids[step:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0
        step *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text) -> tuple[int, ...]:
    """The values of MEASURES for one text."""
    raw = raw_bytes(text)
    words = raw.split()
    if not words:
        return (0,) * len(MEASURES)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - len(raw) + len(raw.translate(None, BLANKS)),
            len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), sum(map(eq, words, words[1:])))


def measured(docs: DataFrame, keep=()) -> DataFrame:
    """The columns ``keep`` and the MEASURES of every whole text."""
    cols = [*dict.fromkeys([*keep, "text"])]

    def run(batches):
        for b in batches:
            m = np.array([measures(t) for t in b.column("text").to_pylist()], dtype=np.int64)
            m = m.reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x) for x in m.T)],
                                             names=[*keep, *MEASURES])

    docs = docs.select(*cols)
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in MEASURES)])
    return docs.mapInArrow(run, schema)


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_PCT * F.col("n_words")))


def rate(name: str) -> Column:
    """A rate in whole thousandths; 0 where there is nothing to divide by."""
    num, den, _, _ = RATES[name]
    return F.when(F.col(den) > 0, F.expr(f"({num} * 1000) div {den}")).otherwise(F.lit(0)).cast("long")


def bucket_of(value: Column) -> Column:
    """Log-linear bucket of a whole number: exact below 128, then 64 buckets per doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return (shift * 128 + F.floor(value / F.pow(F.lit(2.0), shift))).cast("long")


def bucket_low(bucket: Column) -> Column:
    """The smallest value of a bucket."""
    return (F.pmod(bucket, F.lit(128)) * F.pow(F.lit(2.0), F.floor(bucket / 128))).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """Counts per (lang, source, measure, bucket) of the rows that pass the base rule."""
    values = F.array(*[F.struct(F.lit(r).alias("measure"), bucket_of(rate(r)).alias("bucket")) for r in RATES])
    return (rows.where(~base_failed()).select("lang", "source", F.explode(values).alias("v"))
            .groupBy("lang", "source", "v.measure", "v.bucket").agg(F.count(F.lit(1)).alias("n")))


def fences(cells: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source): the fences of every rate, from the smallest level with enough rows.

    ``cells``: sketches, or the union of several.
    """
    level = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), F.lit(None).cast("string").alias("s")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("l"),
                 F.lit(None).cast("string").alias("s"))))
    merged = (cells.withColumn("g", level).select("g.*", "measure", "bucket", "n")
              .groupBy("level", "l", "s", "measure", "bucket").agg(F.sum("n").alias("n")))
    group = Window.partitionBy("level", "l", "s", "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.select("*", F.sum("n").over(upto).alias("cum"), F.sum("n").over(group).alias("tot"))

    def quantile(k: int, measure: str) -> Column:  # the first bucket that reaches k % of the rows
        hit = (F.col("measure") == measure) & (100 * F.col("cum") >= k * F.col("tot"))
        return F.min(F.when(hit, bucket_low(F.col("bucket"))))

    q = ranked.groupBy("level", "l", "s").agg(
        F.max("tot").alias("rows"), *[quantile(25 * k, r).alias(f"{r}_{k}") for r in RATES for k in (1, 3)],
        *[quantile(k, r).alias(f"{r}_top") for r, k in TOP.items()])
    bounds = []
    for r, (_, _, slack, two_sided) in RATES.items():
        reach = REACH * (F.col(f"{r}_3") - F.col(f"{r}_1")) + slack
        high = F.col(f"{r}_3") + reach
        if r in TOP:
            high = F.greatest(high, 2 * F.col(f"{r}_top") + slack)
        bounds.append(high.alias(f"{r}_max"))
        if two_sided:
            bounds.append((F.col(f"{r}_1") - reach).alias(f"{r}_min"))
    q = materialize(q.select("level", "l", "s", "rows", F.struct(*bounds).alias("f")))
    own, lang, everything = (q.where(F.col("level") == k) for k in (0, 1, 2))
    lang = lang.select(F.col("l").alias("l1"), F.col("rows").alias("rows1"), F.col("f").alias("f1"))
    everything = everything.select(F.col("level").alias("level2"), F.col("f").alias("f2"))
    chosen = (F.when(F.col("rows") >= min_group, F.col("f"))
              .when(F.col("rows1") >= min_group, F.col("f1")).otherwise(F.col("f2")))
    return (own.join(lang, own["l"].eqNullSafe(lang["l1"]))
            .join(everything, F.col("level") + 2 == F.col("level2"))
            .select("l", "s", chosen.alias("fence")))


def judged(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds base_failed and kept to measured rows."""
    ok = F.lit(True)
    for r, (_, _, _, two_sided) in RATES.items():
        ok = ok & (rate(r) <= F.col(f"fence.{r}_max"))
        if two_sided:
            ok = ok & (rate(r) >= F.col(f"fence.{r}_min"))
    joined = rows.join(bounds, rows["lang"].eqNullSafe(bounds["l"]) & rows["source"].eqNullSafe(bounds["s"]), "left")
    # a group without a sketch has no row that passed the base rule
    return joined.select(*[rows[c] for c in rows.columns], base_failed().alias("base_failed"),
                         (~base_failed() & F.coalesce(ok, F.lit(False))).alias("kept"))


def quality_rules(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """The columns ``keep`` with MEASURES, base_failed and kept, one row per document."""
    keep = [*dict.fromkeys(keep)]
    rows = materialize(measured(docs, [*dict.fromkeys([*keep, "lang", "source"])]))
    bounds = materialize(fences(materialize(sketches(rows))))
    return judged(rows, bounds).select(*keep, *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of documents."""
    return quality_rules(docs, DOCUMENT_COLUMNS).where("kept").select(*DOCUMENT_COLUMNS)
