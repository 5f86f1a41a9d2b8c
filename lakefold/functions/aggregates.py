"""Aggregates by user code, combined before the shuffle like built-in ones."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States that a partition holds before it passes them on.
STATES = 100_000


@dataclass(frozen=True)
class Aggregate:
    """A start state, a state with a column of values added, two states merged, and a state's result."""

    start: Callable[[], Any]
    update: Callable[[Any, pd.Series], Any]
    merge: Callable[[Any, Any], Any]
    result: Callable[[Any], Any]


def aggregate(df: DataFrame, keys: list[str], value: str, own: Aggregate, name: str, returns: str) -> DataFrame:
    """(keys, name): own over the values of each group, built per partition and merged after one shuffle of states.

    Null values reach update as pandas has them; null keys are a group. An
    empty frame gives no rows. States must pickle; a group's states, one for
    each partition or for each STATES groups of it, are merged one by one.
    """
    rows = df.select(*keys, F.col(value).alias("__value"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Any] = {}

        def out() -> pd.DataFrame:
            made = pd.DataFrame(list(held), columns=keys, dtype=object)
            made["__state"] = [pickle.dumps(s) for s in held.values()]
            return made

        for batch in batches:
            for key, group in batch.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = own.update(held[key] if key in held else own.start(), group["__value"])
            if len(held) >= STATES:
                yield out()
                held.clear()
        if held:
            yield out()

    def merged(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
        state = own.start()
        for s in states["__state"]:
            state = own.merge(state, pickle.loads(s))
        return pd.DataFrame([(*key, own.result(state))], columns=[*keys, name])

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)
    states = rows.mapInPandas(partial, f"{kinds}, __state binary")
    return states.groupBy(*keys).applyInPandas(merged, f"{kinds}, `{name}` {returns}")


def register_aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], Any], returns: str):
    """An aggregate for SQL that sees all values of a group at once: for groups that fit a task's memory."""

    def whole(values: pd.Series):
        return f(values)

    whole.__annotations__ = {"values": pd.Series, "return": {"double": float, "long": int, "bigint": int, "string": str}[returns]}
    return spark.udf.register(name, F.pandas_udf(whole, returns))
