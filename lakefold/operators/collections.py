"""Collection operators over DataFrames: reductions by key, flat maps, per-partition work, unions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduce_by_key(df: DataFrame, key: str, combine: dict[str, Column]) -> DataFrame:
    """Built-in aggregates by key; combined before the shuffle. Null keys are one group; no rows, no groups."""
    return df.groupBy(key).agg(*[c.alias(name) for name, c in combine.items()])


def flat_map(df: DataFrame, items: Column, name: str) -> DataFrame:
    """One row per item of an array; rows with an empty or null array give none."""
    return df.select(F.explode(items).alias(name))


def tokens(df: DataFrame, text: str, name: str = "word") -> DataFrame:
    """Whitespace-separated words, one a row, repeats kept; null, empty and blank texts give none."""
    return flat_map(df, F.split(F.col(text), r"\s+"), name).where(F.col(name) != "")


def word_count(df: DataFrame, text: str) -> DataFrame:
    """(word, n) of the words that tokens gives."""
    return reduce_by_key(tokens(df, text), "word", {"n": F.count("*")})


def map_partitions(df: DataFrame, f: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """f over each partition's Arrow batches; a partition without rows may give none."""
    return df.mapInArrow(f, schema)


def union_bag(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, by column name, repeats kept. Frames must have the same column names; at least one frame."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def total(df: DataFrame, column: str):
    """The sum over all rows, nulls left out; an empty frame raises, as a reduction without a start value must. Null if all values are."""
    n, s = df.agg(F.count("*"), F.sum(column)).first()
    if n == 0:
        raise ValueError("reduction of no rows")
    return s
