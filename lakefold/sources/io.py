"""Reading: test tables, text, CSV in a strict and a lenient form, rows; writing lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakefold.operators.persist import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 lines as one column, value; Spark splits by bytes and reads each split once. Blank lines are rows, an empty file gives none."""
    return spark.read.text(path)


def text_file(df: DataFrame, line: Column) -> str:
    """The path of a new text folder in the shared folder, with a line for each row; null lines are blank."""
    path = fresh_path(df.sparkSession, "lines")
    df.select(F.coalesce(line.cast("string"), F.lit(""))).write.text(path)
    return path


def csv(spark: SparkSession, path: str, schema: str, lenient: bool = False) -> DataFrame:
    """CSV by a declared schema, a record a line: a malformed line raises, or is skipped if lenient.

    A line is malformed if its width or the type of a value is wrong, or if it
    is blank. Each line is parsed whole and checked in a filter, so count, select
    and collect agree on the lines, and any of them raises. Empty fields are
    null; an empty file gives no rows.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    parsed = spark.read.text(path).select("value", F.from_csv("value", f"{schema}, __bad string", options).alias("r"))
    fine = (F.trim("value") != "") & F.col("r.__bad").isNull()
    if not lenient:
        fine = F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), "value")).cast("boolean"))
    return parsed.where(fine).select("r.*").drop("__bad")


def from_rows(spark: SparkSession, rows: Iterable, schema: str | T.StructType | None = None, slices: int | None = None) -> DataFrame:
    """A DataFrame of local rows, types declared or inferred; slices: partitions, the first ones taking one row more. No rows need a declared schema."""
    rows = list(rows)
    if slices is None:
        return spark.createDataFrame(rows, schema)
    each, more = divmod(len(rows), slices)
    cuts = [0]
    for k in range(slices):
        cuts.append(cuts[-1] + each + (k < more))
    parts = spark.sparkContext.parallelize([rows[a:b] for a, b in zip(cuts, cuts[1:])], slices)
    return spark.createDataFrame(parts.flatMap(lambda part: part), schema)


def with_timestamps(df: DataFrame) -> DataFrame:
    """Timestamps without zone as TIMESTAMP, which watermarks need (session zone UTC)."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain})
