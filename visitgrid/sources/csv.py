"""Semicolon CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitgrid import columns as C


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep=";",
             lower_headers=False, rename: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header row and an explicit schema (else all text), headers renamed.

    Files are split by Spark; pass a schema so no extra pass infers one.
    """
    reader = spark.read.option("sep", sep).option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if lower_headers:
        df = df.toDF(*[c.lower() for c in df.columns])
    return df.withColumnsRenamed({a: b for a, b in (rename or {}).items() if a in df.columns})


def read_visits(spark, path, schema=None) -> DataFrame:
    return read_csv(spark, path, schema, rename=C.RENAME_VISITS)


def read_entities(spark, path, schema=None) -> DataFrame:
    return read_csv(spark, path, schema, lower_headers=True, rename=C.RENAME_ENTITIES)


def write_csv(df: DataFrame, path: str, sep=";") -> None:
    """One file per partition under ``path``; nothing is gathered on the driver."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def downcast_numeric(df: DataFrame) -> DataFrame:
    """64-bit to 32-bit numbers. Values beyond the int range would fail under ANSI mode."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.LongType):
            out.append(F.col(f.name).cast("int").alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            out.append(F.col(f.name).cast("float").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
