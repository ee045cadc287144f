"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    An expression that a lambda refers to is otherwise computed anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, op=lambda a, b: a + b) -> Column:
    """Inclusive running values of an array of numbers from 0 on, by an associative ``op`` with 0 as
    neutral element, in about log2(n) passes over it.

    Each pass adds the values that end 2 ** s places before, so nothing grows element by element.
    """
    def more(acc, s):
        step = F.call_function("shiftleft", F.lit(1), s)
        moved = F.concat(F.array_repeat(F.lit(0).cast("long"), step), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - step, F.lit(0))))
        return F.zip_with(acc, moved, op)

    def over(a):
        last = F.ceil(F.log2(F.greatest(F.size(a), F.lit(1)))).cast("int") - 1
        steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(steps, a, more)

    return let(numbers, over)


#: Code points per block of a text that is cut in many places.
BLOCK_CHARS = 4096


def blocks_of(text: Column) -> Column:
    """A text as an array of blocks of BLOCK_CHARS code points."""
    return F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % BLOCK_CHARS), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end`` of a text in blocks; only blocks that the piece
    touches are walked."""
    first, last = F.floor(start / BLOCK_CHARS).cast("int"), F.floor((end - 1) / BLOCK_CHARS).cast("int")

    def part(i):
        at = F.greatest(start - i * BLOCK_CHARS, F.lit(0)).cast("int")
        return F.substring(F.get(blocks, i), at + 1, (F.least(end - i * BLOCK_CHARS, F.lit(BLOCK_CHARS)) - at).cast("int"))

    return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows never learned from: crc32(doc_id as text) mod 4 is 2 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def raw_bytes(text) -> bytes:
    """UTF-8 of a text; null is empty. bytes.split() and bytes.lower() know ASCII only, as the
    word rule ``[^\\x20\\x09-\\x0D]+`` and the lower-casing of A-Z ask."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def hash_sample(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows of (doc_id, text, ...), those with the smallest hash of both.

    Only hashes are sorted, ``n`` of each partition; the texts of other rows never move.
    """
    h = F.xxhash64("doc_id", F.xxhash64("text"))
    last = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(last)).limit(n) if last is not None else df.limit(0)
