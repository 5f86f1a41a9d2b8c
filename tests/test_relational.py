"""Filters, joins, aggregates, functions, views and sources on small literals."""

import os
import subprocess
import sys

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from lakefold.functions import aggregates, compat, registry as functions
from lakefold.operators import collections as coll
from lakefold.operators import persist
from lakefold.plans import views
from lakefold.sources import io, records

STAFF = [(1, "Alice", "eng", 72000), (2, "Bob", "ops", 45000), (3, "Cathy", "eng", 83000), (4, "David", "sales", 51000), (5, "Eva", "sales", 39000), (6, "Frank", "ops", 67000)]


@pytest.fixture(scope="module")
def staff(spark):
    df = io.from_rows(spark, STAFF, "id int, name string, department string, salary int")
    df.createOrReplaceTempView("employees")
    io.from_rows(spark, [("eng", "Engineering"), ("ops", "Operations"), ("sales", "Sales")], "dept_code string, dept_name string").createOrReplaceTempView("departments")
    return df


def test_joins(spark, staff):
    rows = spark.sql("SELECT name, dept_name FROM employees JOIN departments ON departments.dept_code = employees.department").collect()
    assert len(rows) == 6 and {"name": "Alice", "dept_name": "Engineering"} in [r.asDict() for r in rows]
    left = spark.sql("SELECT name, dept_name FROM employees LEFT JOIN departments ON department = dept_code AND dept_code <> 'sales'").collect()
    assert {r.name for r in left if r.dept_name is None} == {"David", "Eva"}


def test_aggregates(spark, staff):
    got = {r.department: (r.s, r.a) for r in staff.groupBy("department").agg(compat.sum_or_zero(F.col("salary")).alias("s"), compat.avg_or_zero(F.col("salary")).alias("a")).collect()}
    assert got == {"eng": (155000.0, 77500.0), "ops": (112000.0, 56000.0), "sales": (90000.0, 45000.0)}
    none = staff.groupBy("department").agg(compat.sum_or_zero(F.lit(None)).alias("s")).first()
    assert none.s == 0.0


def test_bands_by_function(spark, staff):
    functions.register_scalar(spark, "band_of", lambda v: "high" if v >= 70000 else "mid" if v >= 50000 else "low", "string", vectorised=False)
    got = {r.b: r.n for r in spark.sql("SELECT band_of(salary) AS b, count(*) AS n FROM employees GROUP BY band_of(salary)").collect()}
    assert got == {"high": 2, "mid": 2, "low": 2}


def test_builders():
    made = functions.Builders()
    made.register("Up", F.upper)
    assert made.exists("UP") and made.names() == ["up"] and made.drop("uP") and not made.exists("up")


def test_null_safe(spark):
    a = io.from_rows(spark, [(None,), (1,)], "k int")
    b = io.from_rows(spark, [(None,), (1,)], "j int")
    assert a.join(b, F.col("k") == F.col("j")).count() == 1
    assert compat.join_null_safe(a, b, [("k", "j")]).count() == 2


def test_errors(spark, staff):
    with pytest.raises(ParseException):
        spark.sql("SELECT a FROM (")
    with pytest.raises(AnalysisException):
        spark.sql("SELECT nope FROM employees")
    assert views.syntax_error(spark, "SELECT name\n  FROM (employees") == (2, 17)
    assert views.syntax_error(spark, "SELECT name FROM employees") is None and views.syntax_error(spark, "SELECT nope FROM employees") is None
    assert views.resolution_error(spark, "SELECT name FROM employees") is None


def test_views(spark, capfd):
    df = io.from_rows(spark, [(k, "x" * 40) for k in range(25)], "k int, t string")
    views.create_view(df, "tv_one", replace=False)
    with pytest.raises(AnalysisException):
        views.create_view(df, "tv_one", replace=False)
    assert spark.table("tv_one").count() == 25 and views.drop_view(spark, "tv_one") and not views.drop_view(spark, "tv_one")
    views.show_all(df)
    shown = capfd.readouterr().out
    assert shown.count("x" * 40) == 25
    text = views.explained(df.where("k > 3"))
    assert all(f"== {part} Plan ==" in text for part in ("Parsed Logical", "Analyzed Logical", "Optimized Logical", "Physical"))


def test_views_are_cleared(spark):
    other = spark.newSession()
    views.create_view(other.range(3), "tv_a")
    views.create_view(other.range(3), "tv_b")
    assert views.clear_views(other) == 2 and views.clear_views(other) == 0


def test_text_and_records(spark):
    df = io.from_rows(spark, [("a b",), ("",), (None,), ("é",)], "t string")
    path = io.text_file(df, F.col("t"))
    assert sorted(r.value for r in io.text_lines(spark, path).collect()) == ["", "", "a b", "é"]
    records.register(spark)
    assert sorted(r.value for r in spark.read.format("lakefold_records").option("path", path).load().collect()) == ["", "", "a b", "é"]


def test_records_of_numbers(spark, tmp_path):
    for k, numbers in enumerate(([1, -2], [], [1 << 40])):
        (tmp_path / f"{k}.bin").write_bytes(b"".join(n.to_bytes(8, "big", signed=True) for n in numbers))
    records.register(spark)
    read = spark.read.format("lakefold_records").option("path", str(tmp_path)).option("decoder", "longs")
    assert sorted(r.value for r in read.load().collect()) == [-2, 1, 1 << 40]
    (tmp_path / "3.bin").write_bytes(b"short")
    with pytest.raises(Exception, match="ends early"):
        read.load().collect()


def test_user_aggregate(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0), (None, 7.0)]
    mean = aggregates.Aggregate(lambda: (0, 0.0), lambda s, x: (s[0] + int(x.count()), s[1] + float(x.sum())), lambda s, t: (s[0] + t[0], s[1] + t[1]), lambda s: s[1] / s[0] if s[0] else None)
    df = io.from_rows(spark, rows, "k string, v double").repartition(3)
    assert {r.k: r.m for r in aggregates.aggregate(df, ["k"], "v", mean, "m", "double").collect()} == {"a": 2.0, "b": None, None: 6.0}
    assert aggregates.aggregate(df.limit(0), ["k"], "v", mean, "m", "double").count() == 0
    aggregates.register_aggregate(spark, "span_of", lambda x: float(x.max() - x.min()), "double")
    io.from_rows(spark, rows[:2], "k string, v double").createOrReplaceTempView("tv_spans")
    assert spark.sql("SELECT k, span_of(v) AS s FROM tv_spans GROUP BY k").first().s == 2.0


def test_pushdown(spark):
    plan = io.table(spark, "/root/testdata/sf0.001", "lineitem").where("l_quantity > 30").select("l_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_split_and_reduce(spark):
    df = io.from_rows(spark, [(i,) for i in range(1, 6)], "i int", 3)
    assert df.rdd.glom().map(lambda p: [r.i for r in p]).collect() == [[1, 2], [3, 4], [5]]
    assert coll.total(df, "i") == 15
    with pytest.raises(ValueError):
        coll.total(df.where("i > 9"), "i")


def test_word_count(spark):
    df = io.from_rows(spark, [("hello world hello spark",), ("world hello java spark hello",), ("",), (None,)], "t string")
    assert {r.word: r.n for r in coll.word_count(df, "t").collect()} == {"hello": 4, "world": 2, "spark": 2, "java": 1}


def test_csv(spark, tmp_path):
    path, schema = str(tmp_path / "x.csv"), "a double, b double, y int"
    (tmp_path / "x.csv").write_text("1.0,2.0,0\n\nbad\n1,2,x\n1,2\n1,2,3,4\n3.0,,1\n")
    found = io.csv(spark, path, schema, lenient=True)
    assert found.count() == 2 and [r.y for r in found.select("y").orderBy("y").collect()] == [0, 1]
    assert sorted(tuple(r) for r in found.collect()) == [(1.0, 2.0, 0), (3.0, None, 1)]
    strict = io.csv(spark, path, schema)
    for act in (strict.count, strict.collect, strict.select("y").collect):
        with pytest.raises(Exception, match="malformed line"):
            act()
    (tmp_path / "x.csv").write_text("")
    assert io.csv(spark, path, schema).count() == 0


def test_checkpoint_cuts_lineage(spark):
    ran = persist.compute_counter(spark)

    def count(batches):
        ran.add(1)
        yield from batches

    df = persist.checkpointed(spark.range(9).repartition(3).mapInArrow(count, "id long"))
    before = ran.value
    assert sorted(r.id for r in df.collect()) == list(range(9)) and df.count() == 9 and ran.value == before


def test_retry(spark):
    """A task that fails once is run again, and only that one."""
    def flaky(batches):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() == 0 and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("once")
        yield from batches

    df = spark.range(0, 4, 1, 2).mapInArrow(flaky, "id long")
    assert sorted(r.id * 10 for r in df.collect()) == [0, 10, 20, 30]


@pytest.mark.parametrize("level", sorted(persist.LEVELS))
def test_persist_levels(spark, level):
    """Kept rows are computed once, others each time."""
    ran = persist.compute_counter(spark)

    def count(batches):
        ran.add(1)
        yield from batches

    with persist.cached(spark.range(0, 9, 1, 3).mapInArrow(count, "id long"), level) as df:
        assert [df.count() for _ in range(3)] == [9, 9, 9]
        assert ran.value == (9 if level == "NONE" else 3)


_LOST_OUTPUT = """
import glob, os, sys
from pyspark.sql import SparkSession
conf = {"spark.master": "local-cluster[2,1,512]", "spark.executor.memory": "512m", "spark.local.dir": sys.argv[1], "spark.ui.enabled": "false"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
ran = spark.sparkContext.accumulator(0)
def paired(x):
    ran.add(1)
    return x % 5, 1
counts = spark.sparkContext.parallelize(range(30), 3).map(paired).reduceByKey(lambda a, b: a + b, 2)
first, before = sorted(counts.collect()), ran.value
os.remove(sorted(glob.glob(sys.argv[1] + "/**/shuffle_*.data", recursive=True))[0])
print("RESULT", first == sorted(counts.collect()) == [(k, 6) for k in range(5)], before, ran.value)
spark.stop()
"""


def test_lost_map_output(tmp_path):
    """A map output that is gone is made again after the fetch fails, and the result is whole. In a cluster of its own, as executors are given up."""
    env = {k: v for k, v in os.environ.items() if k != "SPARK_LOCAL_DIRS"}
    said = subprocess.run([sys.executable, "-c", _LOST_OUTPUT, str(tmp_path)], env=env, capture_output=True, text=True, timeout=240)
    _, same, before, after = next(x for x in said.stdout.splitlines() if x.startswith("RESULT")).split()
    assert same == "True" and int(before) == 30 < int(after) <= 60
