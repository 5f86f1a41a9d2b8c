"""User functions by name: scalar functions, and builders that return a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession


def register_scalar(spark: SparkSession, name: str, f: Callable, returns: str, vectorised: bool = True):
    """A scalar function of any arity, callable from SQL; vectorised ones get pandas Series by Arrow."""
    from pyspark.sql import functions as F

    made = F.pandas_udf(f, returns) if vectorised else F.udf(f, returns)
    return spark.udf.register(name, made)


def register_sql(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A macro: the body is inlined into the plan and optimised with it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


class Builders:
    """Case-insensitive registry of functions that build Columns."""

    def __init__(self):
        self._found: dict[str, Callable[..., Column]] = {}

    def register(self, name: str, f: Callable[..., Column]) -> None:
        self._found[name.lower()] = f

    def lookup(self, name: str) -> Callable[..., Column]:
        return self._found[name.lower()]

    def exists(self, name: str) -> bool:
        return name.lower() in self._found

    def drop(self, name: str) -> bool:
        return self._found.pop(name.lower(), None) is not None

    def names(self) -> list[str]:
        return sorted(self._found)
