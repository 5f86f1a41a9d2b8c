"""Named views, showing and explaining frames, and what is wrong with a text of SQL."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession


def create_view(df: DataFrame, name: str, replace: bool = True) -> None:
    """A temporary view of df. Without replace, a view of that name raises."""
    if replace:
        df.createOrReplaceTempView(name)
    else:
        df.createTempView(name)


def drop_view(spark: SparkSession, name: str) -> bool:
    """Whether there was a temporary view of that name, which is gone now."""
    return spark.catalog.dropTempView(name)


def clear_views(spark: SparkSession) -> int:
    """Drops all temporary views of the session; how many there were."""
    names = [t.name for t in spark.catalog.listTables() if t.isTemporary]
    for name in names:
        spark.catalog.dropTempView(name)
    return len(names)


def show_all(df: DataFrame) -> None:
    """Prints every row, nothing shortened: for frames that fit the driver."""
    df.show(max(1, df.count()), truncate=False)


def explained(df: DataFrame) -> str:
    """The parsed, analysed, optimised and physical plan."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("extended")
    return out.getvalue()


def syntax_error(spark: SparkSession, text: str) -> tuple[int, int] | None:
    """(line, position in it) at which a text of SQL cannot be parsed, both as Spark counts them; null if it can be."""
    try:
        spark.sql(text)
    except ParseException as e:
        line, at = re.search(r"\(line (\d+), pos (\d+)\)", str(e)).groups()
        return int(line), int(at)
    except AnalysisException:
        return None
    return None


def resolution_error(spark: SparkSession, text: str) -> str | None:
    """The condition under which names of a text of SQL cannot be resolved, such as an ambiguous column; null if they can be."""
    try:
        spark.sql(text)
    except AnalysisException as e:
        return e.getCondition()
    return None
