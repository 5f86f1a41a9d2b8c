"""All queries of this engine but those of `llm`, by name, with their SQL.

A query is (spark, sf_dir) -> DataFrame. Queries that are plain SQL in both
engines share their text; others are written with the DataFrame API or an
operator of this library and have DuckDB SQL beside them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakefold.functions import aggregates, compat, registry as functions
from lakefold.operators import collections as coll
from lakefold.operators import persist
from lakefold.plans import iterative, views
from lakefold.sources import io, records
from lakefold.sources.io import from_rows, table, with_timestamps
from lakefold.streaming import replay

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function as a query, with its SQL."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers SQL text that Spark runs over views of the tables it names; oracle: where DuckDB needs another text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in text:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    query(name, oracle or text)(run)


# --- projections, filters, predicates, expressions

sql("flagship", "SELECT l_returnflag, count(*) AS c, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem WHERE l_quantity > 30 GROUP BY l_returnflag")


@query("filter_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 1.1::DOUBLE, 4) AS adjusted FROM lineitem WHERE l_quantity > 30")
def _(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_quantity") > 30)
    return li.select("l_orderkey", "l_linenumber", F.round(compat.times(F.col("l_extendedprice"), 1.1), 4).alias("adjusted"))


for _name, _op in (("eq", "="), ("eq2", "=="), ("ne", "<>"), ("ne2", "!="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    sql(f"cmp_{_name}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 20")
sql("cmp_string", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
sql("and_or_precedence", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR c_acctbal < 0 AND (c_mktsegment = 'BUILDING' OR c_nationkey = 3)")
sql("not_and_arithmetic", "SELECT p_partkey, -p_size + 2 * 3 - p_size % 7 AS x FROM part WHERE NOT p_size > 10")
sql(
    "literals_quoted_idents",
    "SELECT `n_name` AS `select`, 7 AS i, CAST(1.5 AS DOUBLE) AS d, 'it' AS s, TRUE AS b, CAST(NULL AS INT) AS z /* block */ FROM nation n WHERE n.n_nationkey >= 0 -- line",
    "SELECT n_name AS \"select\", 7 AS i, CAST(1.5 AS DOUBLE) AS d, 'it' AS s, TRUE AS b, CAST(NULL AS INT) AS z FROM nation",
)
sql("select_star", "SELECT * FROM nation WHERE n_regionkey = 1")
sql("int_calc", "SELECT p_partkey, CAST(((p_size + 2) * 3 - 4) div 4 AS BIGINT) AS v FROM part", "SELECT p_partkey, CAST(((p_size + 2) * 3 - 4) // 4 AS BIGINT) AS v FROM part")


@query("parse_expression", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part WHERE p_size > 5 AND p_size <= 9")
def _(spark, d):
    return table(spark, d, "part").where(F.expr("p_size > 5 AND p_size <= 9")).select("p_partkey", F.expr("p_size * 2 + 1").alias("v"))


@query("syntax_error_position", "SELECT * FROM (VALUES ('SELECT a FROM (', 1, 15), ('SELECT n_name\nFROM (nation', 2, 12)) t(text, line, pos)")
def _(spark, d):
    texts = ("SELECT a FROM (", "SELECT n_name\nFROM (nation")
    return spark.createDataFrame([(t, *views.syntax_error(spark, t)) for t in texts], "text string, line int, pos int")


# --- sources

@query("text_source", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    return io.text_lines(spark, io.text_file(table(spark, d, "part"), F.col("p_brand"))).groupBy("value").agg(F.count("*").alias("n"))


def _csv_lines(spark: SparkSession, d: str, bad: bool) -> str:
    """Lines of key and size; bad: each tenth is too short, blank, too wide or no number."""
    line = F.concat_ws(",", "p_partkey", "p_size")
    broken = F.element_at(F.array(F.lit("7"), F.lit(""), F.concat(line, F.lit(",1")), F.lit("x,y")), (F.col("p_partkey") / 10 % 4).cast("int") + 1)
    return io.text_file(table(spark, d, "part"), F.when((F.col("p_partkey") % 10 == 0) & F.lit(bad), broken).otherwise(line))


@query("csv_strict", "SELECT p_partkey AS k, CAST(p_size AS INTEGER) AS size FROM part")
def _(spark, d):
    return io.csv(spark, _csv_lines(spark, d, False), "k long, size int")


@query("csv_lenient", "SELECT p_partkey AS k, CAST(p_size AS INTEGER) AS size FROM part WHERE p_partkey % 10 <> 0")
def _(spark, d):
    return io.csv(spark, _csv_lines(spark, d, True), "k long, size int", lenient=True)


@query("csv_lenient_count", "SELECT count(*) AS n FROM part WHERE p_partkey % 10 <> 0")
def _(spark, d):
    return io.csv(spark, _csv_lines(spark, d, True), "k long, size int", lenient=True).agg(F.count("*").alias("n"))


@query("custom_source", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    records.register(spark)
    path = io.text_file(table(spark, d, "part"), F.col("p_brand"))
    return spark.read.format("lakefold_records").option("path", path).option("decoder", "lines").load().groupBy("value").agg(F.count("*").alias("n"))


# --- aggregations

@query("group_count", 'SELECT o_orderpriority, count(*) AS "count" FROM orders GROUP BY o_orderpriority')
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").count()


sql("group_count_filtered", "SELECT o_orderpriority, count(1) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")
sql("count_nonnull", "SELECT c_mktsegment, count(*) AS rows_, count(o_orderkey) AS orders_ FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_mktsegment")
sql("group_sum", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("group_avg", "SELECT l_returnflag, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
sql("multi_agg", "SELECT l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS p, round(avg(l_discount), 6) AS a FROM lineitem GROUP BY l_linestatus")


@query("sum_all_null_compat", "SELECT n_regionkey, coalesce(sum(CAST(nullif(n_nationkey, n_nationkey) AS DOUBLE)), 0.0) AS s, coalesce(avg(CAST(nullif(n_nationkey, n_nationkey) AS DOUBLE)), 0.0) AS a FROM nation GROUP BY n_regionkey")
def _(spark, d):
    x = F.nullif(F.col("n_nationkey"), F.col("n_nationkey"))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(compat.sum_or_zero(x).alias("s"), compat.avg_or_zero(x).alias("a"))


sql("group_by_expression", "SELECT p_size % 5 AS k, count(*) AS n FROM part GROUP BY p_size % 5")


@query("reduce_by_key", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def _(spark, d):
    return coll.reduce_by_key(table(spark, d, "orders"), "o_custkey", {"n": F.count("*"), "top": F.max("o_totalprice")})


@query("vector_component_sums", "SELECT CAST(pos - 1 AS INT) AS pos, round(sum(CAST(x AS DOUBLE)), 3) AS s FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos")
def _(spark, d):
    parts = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    return parts.groupBy("pos").agg(F.round(F.sum(F.col("x").cast("double")), 3).alias("s"))


@query("user_aggregate", "SELECT p_brand, round(sqrt(sum(CAST(p_size AS DOUBLE) * p_size) / count(p_size)), 9) AS rms FROM part GROUP BY p_brand")
def _(spark, d):
    """Root mean square as start, update, merge and result of a state."""
    rms = aggregates.Aggregate(
        start=lambda: (0, 0.0),
        update=lambda s, x: (s[0] + int(x.count()), s[1] + float((x.astype("float64") ** 2).sum())),
        merge=lambda s, t: (s[0] + t[0], s[1] + t[1]),
        result=lambda s: (s[1] / s[0]) ** 0.5 if s[0] else None,
    )
    found = aggregates.aggregate(table(spark, d, "part"), ["p_brand"], "p_size", rms, "rms", "double")
    return found.select("p_brand", F.round("rms", 9).alias("rms"))


@query("user_aggregate_sql", "SELECT p_brand, CAST(quantile_disc(p_size, 0.5) AS BIGINT) AS mid FROM part GROUP BY p_brand")
def _(spark, d):
    aggregates.register_aggregate(spark, "lower_median", lambda x: int(x.sort_values().iloc[(len(x) - 1) // 2]), "long")
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_brand, lower_median(p_size) AS mid FROM part GROUP BY p_brand")


# --- joins

sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
sql("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 45")
sql("join_reversed", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
sql("join_qualified", "SELECT nation.n_name, region.r_name FROM nation INNER JOIN region ON nation.n_regionkey = region.r_regionkey")
sql("join_chain", "SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
sql("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
sql("join_then_filter", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name <> 'NATION_1' AND s_acctbal > 0")


@query("join_nullsafe", "SELECT a.k AS k, a.n_name AS left_name, b.n_name AS right_name FROM (SELECT nullif(n_regionkey, 2) AS k, n_name FROM nation) a JOIN (SELECT nullif(n_regionkey, 2) AS k, n_name FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def _(spark, d):
    n = table(spark, d, "nation").select(F.nullif(F.col("n_regionkey"), F.lit(2)).alias("k"), "n_name")
    right = n.toDF("k2", "right_name")
    return compat.join_null_safe(n, right, [("k", "k2")]).select("k", F.col("n_name").alias("left_name"), "right_name")


@query("eq_nullsafe_filter", "SELECT n_name FROM nation WHERE nullif(n_regionkey, 1) IS NOT DISTINCT FROM NULL OR n_regionkey IS DISTINCT FROM 3")
def _(spark, d):
    k = F.nullif(F.col("n_regionkey"), F.lit(1))
    return table(spark, d, "nation").where(compat.same(k, F.lit(None)) | compat.differs(F.col("n_regionkey"), F.lit(3))).select("n_name")


@query("join_broadcast_small", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5")
def _(spark, d):
    """The plan is left to Spark: it broadcasts part only while its size is under the threshold."""
    part = table(spark, d, "part").where("p_size < 5").select("p_partkey", "p_brand")
    return table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand")


# --- user functions, views, catalogue

_BAND = "CASE WHEN c_acctbal >= 7000 THEN 'high' WHEN c_acctbal >= 3000 THEN 'mid' ELSE 'low' END"


@query("group_by_udf", f"SELECT {_BAND} AS band, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    def band(x: pd.Series) -> pd.Series:
        return pd.Series(np.select([x >= 7000, x >= 3000], ["high", "mid"], "low"))

    functions.register_scalar(spark, "acct_band", band, "string")
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT acct_band(c_acctbal) AS band, count(*) AS n FROM customer GROUP BY acct_band(c_acctbal)")


@query("udf_two_args", "SELECT p_partkey, p_brand || '-' || CAST(p_size AS VARCHAR) AS tag FROM part")
def _(spark, d):
    def tag(a: pd.Series, b: pd.Series) -> pd.Series:
        return a + "-" + b.astype(str)

    functions.register_scalar(spark, "tag_of", tag, "string")
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, tag_of(p_brand, p_size) AS tag FROM part")


@query("udf_in_where", "SELECT p_partkey FROM part WHERE p_size % 7 = 3")
def _(spark, d):
    functions.register_scalar(spark, "seventh", lambda x: x % 7, "int")
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey FROM part WHERE seventh(p_size) = 3")


@query("macro_udf", "SELECT s_suppkey, round(s_acctbal * 2 + 1, 2) AS v FROM supplier")
def _(spark, d):
    functions.register_sql(spark, "twice_and", "x DOUBLE, y DOUBLE", "DOUBLE", "x * 2 + y")
    table(spark, d, "supplier").createOrReplaceTempView("supplier")
    return spark.sql("SELECT s_suppkey, round(twice_and(s_acctbal, 1D), 2) AS v FROM supplier")


@query("builder_udf", "SELECT n_name, upper(n_name) || '!' AS loud FROM nation")
def _(spark, d):
    made = functions.Builders()
    made.register("Loud", lambda c: F.concat(F.upper(c), F.lit("!")))
    return table(spark, d, "nation").select("n_name", made.lookup("lOUD")(F.col("n_name")).alias("loud"))


@query("view_roundtrip", "SELECT * FROM orders WHERE o_totalprice > 200000")
def _(spark, d):
    table(spark, d, "orders").where("o_totalprice > 200000").createOrReplaceTempView("dear_orders")
    return spark.table("dear_orders")


@query("view_lifecycle", "SELECT * FROM (VALUES ('create again', 'TEMP_TABLE_OR_VIEW_ALREADY_EXISTS'), ('drop', 'true'), ('drop again', 'false'), ('after drop', 'TABLE_OR_VIEW_NOT_FOUND'), ('replace', '25')) t(step, outcome)")
def _(spark, d):
    nations, steps = table(spark, d, "nation"), []
    views.create_view(nations.limit(0), "lf_nations")
    try:
        views.create_view(nations, "lf_nations", replace=False)
    except AnalysisException as e:
        steps.append(("create again", e.getCondition()))
    views.create_view(nations, "lf_nations")
    steps.append(("replace", str(spark.table("lf_nations").count())))
    steps += [(step, str(views.drop_view(spark, "lf_nations")).lower()) for step in ("drop", "drop again")]
    steps.append(("after drop", views.resolution_error(spark, "SELECT * FROM lf_nations")))
    return spark.createDataFrame(steps, "step string, outcome string")


@query("resolution_errors", "SELECT * FROM (VALUES ('AMBIGUOUS_REFERENCE'), ('UNRESOLVED_COLUMN.WITH_SUGGESTION'), ('UNRESOLVED_COLUMN.WITH_SUGGESTION')) t(condition)")
def _(spark, d):
    """An ambiguous column, an unknown one and an unknown qualifier."""
    table(spark, d, "nation").createOrReplaceTempView("nation")
    joined = "FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"
    found = [views.resolution_error(spark, f"SELECT {c} {joined}") for c in ("n_name", "nope", "c.n_name")]
    return spark.createDataFrame([(x,) for x in found], "condition string")


# --- collections

@query("word_count", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def _(spark, d):
    return coll.word_count(table(spark, d, "documents"), "text")


@query("flat_map", "SELECT unnest(string_split(n_name, '_')) AS piece FROM nation")
def _(spark, d):
    return coll.flat_map(table(spark, d, "nation"), F.split("n_name", "_"), "piece")


@query("map_partitions", "SELECT p_partkey, p_size * 10 AS v FROM part")
def _(spark, d):
    import pyarrow.compute as pc

    def tenfold(batches):
        for b in batches:
            yield b.set_column(1, "v", pc.multiply(b.column(1), 10).cast("int32"))

    return coll.map_partitions(table(spark, d, "part").select("p_partkey", "p_size"), tenfold, "p_partkey long, v int")


@query("reduce_total", "SELECT CAST(sum(p_size) AS BIGINT) AS total, count(*) AS n FROM part")
def _(spark, d):
    part = table(spark, d, "part")
    return spark.createDataFrame([(coll.total(part, "p_size"), part.count())], "total long, n long")


@query("partition_counts", "SELECT CAST(part AS INTEGER) AS part, CAST(n AS BIGINT) AS n FROM (VALUES (0, 9), (1, 8), (2, 8)) t(part, n)")
def _(spark, d):
    """Rows of each of three partitions of a local list: 9 and 8 and 8 of 25."""
    rows = from_rows(spark, [(i,) for i in range(25)], "i int", 3)
    return rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))


@query("union_bag", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(spark, d):
    return coll.union_bag(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("checkpoint_lineage", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5")
def _(spark, d):
    return persist.checkpointed(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))).where("n > 5")


@query("cache_levels", "SELECT level, o_orderstatus, count(*) AS n FROM orders, (VALUES ('MEMORY_ONLY'), ('DISK_ONLY'), ('MEMORY_AND_DISK'), ('NONE')) t(level) GROUP BY 1, 2")
def _(spark, d):
    found = []
    for level in persist.LEVELS:
        with persist.cached(table(spark, d, "orders").select("o_orderstatus"), level) as kept:
            found.append(persist.checkpointed(kept.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("level", F.lit(level))))
    return coll.union_bag(*found)


def _counted(spark: SparkSession, parts: int) -> tuple[DataFrame, Callable[[], int]]:
    """A frame of six rows in so many partitions, and how often one of them has been computed."""
    ran = persist.compute_counter(spark)

    def count(batches):
        ran.add(1)
        yield from batches

    return coll.map_partitions(spark.range(0, 6, 1, parts), count, "id long"), lambda: ran.value


@query("compute_counts", "SELECT * FROM (VALUES ('MEMORY_AND_DISK', 1, 3), ('MEMORY_AND_DISK', 2, 0), ('MEMORY_AND_DISK', 3, 0), ('NONE', 1, 3), ('NONE', 2, 3), ('NONE', 3, 3)) t(level, epoch, computed)")
def _(spark, d):
    """Partitions computed in each of three passes over three, kept and not."""
    found = []
    for level in ("MEMORY_AND_DISK", "NONE"):
        rows, ran = _counted(spark, 3)
        with persist.cached(rows, level) as kept:
            for epoch in (1, 2, 3):
                before = ran()
                kept.agg(F.sum("id")).first()
                found.append((level, epoch, ran() - before))
    return spark.createDataFrame(found, "level string, epoch int, computed int")


@query("task_metadata", "SELECT CAST(p AS INTEGER) AS part, CAST(0 AS INTEGER) AS attempt, CAST(2 AS BIGINT) AS n FROM (VALUES (0), (1), (2)) t(p)")
def _(spark, d):
    """Partition, attempt and rows of each task."""
    import pyarrow as pa

    def told(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get(), sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([task.attemptNumber()], pa.int32()), pa.array([n], pa.int64())], ["part", "attempt", "n"])

    return coll.map_partitions(spark.range(0, 6, 1, 3), told, "part int, attempt int, n long")


@query("explain_sections", "SELECT * FROM (VALUES ('Analyzed Logical', true), ('Optimized Logical', true), ('Parsed Logical', true), ('Physical', true)) t(plan, there)")
def _(spark, d):
    text = views.explained(table(spark, d, "nation").where("n_regionkey = 1").select("n_name"))
    names = ("Parsed Logical", "Analyzed Logical", "Optimized Logical", "Physical")
    return spark.createDataFrame([(x, f"== {x} Plan ==" in text) for x in names], "plan string, there boolean")


# --- streaming

def _events(spark: SparkSession, d: str) -> DataFrame:
    return with_timestamps(table(spark, d, "events"))


def _replayed(spark: SparkSession, d: str, batches: int = 3) -> DataFrame:
    return replay.staged(_events(spark, d), F.col("event_id") % batches, batches)


_BY_TYPE = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"


@query("stream_complete", _BY_TYPE)
def _(spark, d):
    return replay.run(_replayed(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), "complete", name="lf_complete")


@query("stream_memory_sink", _BY_TYPE)
def _(spark, d):
    return replay.to_memory(_replayed(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), "complete", f"lf_memory_{uuid.uuid4().hex}")


@query("stream_update_final", _BY_TYPE)
def _(spark, d):
    return replay.run(_replayed(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), "update", ["event_type"])


@query("stream_append_per_batch", "SELECT CAST(event_id % 3 AS BIGINT) AS b, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return replay.each_batch(_replayed(spark, d), lambda df, k: df.groupBy((F.col("event_id") % 3).alias("b"), "event_type").agg(F.count("*").alias("n")))


@query("stream_empty_batches", "SELECT CAST(b AS BIGINT) AS b, CAST(0 AS BIGINT) AS n FROM (VALUES (0), (1), (2)) t(b)")
def _(spark, d):
    """Batches of which nothing is left still come, and are counted as empty."""
    nothing = _replayed(spark, d).where("value < -1000000")
    return replay.each_batch(nothing, lambda df, k: df.agg(F.count("*").alias("n")).withColumn("b", F.lit(k).cast("long")))


@query("stream_restart", "SELECT CASE WHEN event_id % 3 < 2 THEN 1 ELSE 2 END AS run, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    """A second run on the same offsets takes what has come since, and nothing twice."""
    events, path, offsets = _events(spark, d), persist.fresh_path(spark, "arriving"), persist.fresh_path(spark, "offsets")
    late = F.col("event_id") % 3 == 2
    found = []
    for run, part in ((1, events.where(~late)), (2, events.where(late))):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        found.append(replay.each_batch(stream, lambda df, k: df, offsets).withColumn("run", F.lit(run)))
    return coll.union_bag(*found).groupBy("run", "event_type").agg(F.count("*").alias("n"))


@query("stream_handle", "SELECT 3 AS batches, false AS stopped_before, true AS stopped_after, CAST(sum(n) AS BIGINT) AS rows_ FROM (SELECT count(*) AS n FROM events)")
def _(spark, d):
    running = replay.start(_replayed(spark, d), lambda df, k: df.count())
    running.process_all()
    before, batches, rows = running.stopped(), running.batches(), sum(running.rows())
    running.stop()
    return spark.createDataFrame([(batches, before, running.stopped(), rows)], "batches int, stopped_before boolean, stopped_after boolean, rows_ long")


@query("stream_map_filter_flatmap", "SELECT event_id, unnest(string_split(event_type, 'c')) AS piece FROM events WHERE value > 50")
def _(spark, d):
    return replay.run(_replayed(spark, d).where("value > 50").select("event_id", F.explode(F.split("event_type", "c")).alias("piece")), "append")


@query("stream_sql_view", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def _(spark, d):
    _replayed(spark, d).createOrReplaceTempView("lf_event_stream")
    return replay.run(spark.sql("SELECT user_id, count(*) AS n FROM lf_event_stream WHERE event_type = 'purchase' GROUP BY user_id"), "complete")


@query("stream_static_join", "SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE event_type = 'error'")
def _(spark, d):
    joined = _replayed(spark, d).where("event_type = 'error'").join(table(spark, d, "nation"), F.expr("user_id % 25 = n_nationkey"))
    return replay.run(joined.select("event_id", "n_name"), "append")


#: Periods of eight days, four in the month of the events.
_PERIOD = "(datediff(ts, DATE '2024-01-01') div 8)"


def _by_period(spark: SparkSession, d: str, late: str = "0") -> DataFrame:
    """Events in the order of time, a period a batch; late: periods by which a row comes later."""
    return replay.staged(_events(spark, d), F.expr(f"least(3, {_PERIOD} + {late})"), 4)


@query(
    "stream_stream_join",
    "SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'",
)
def _(spark, d):
    """Both sides are streams; watermarks and the time range bound the rows that either has to remember."""
    c = _by_period(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("cu"), F.col("ts").alias("ct")).withWatermark("ct", "1 hour")
    p = _by_period(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("pu"), F.col("ts").alias("pt")).withWatermark("pt", "1 hour")
    return replay.run(c.join(p, F.expr("cu = pu AND pt >= ct AND pt <= ct + INTERVAL 6 HOURS")).select("click", "purchase"), "append")


@query(
    "event_window_watermark",
    """WITH e AS (SELECT event_type, ts, time_bucket(INTERVAL 1 HOUR, ts) AS start_, least(3, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 8 + CASE WHEN event_id % 20 = 7 THEN 2 ELSE 0 END) AS b FROM events),
    m AS (SELECT b, max(ts) AS top FROM e GROUP BY b),
    w AS (SELECT k.b, (SELECT max(top) - INTERVAL 1 DAY FROM m WHERE m.b < k.b - 1) AS mark FROM m k)
    SELECT start_, event_type, count(*) AS n FROM e JOIN w USING (b)
    WHERE (mark IS NULL OR start_ + INTERVAL 1 HOUR > mark) AND start_ + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM e) GROUP BY 1, 2""",
)
def _(spark, d):
    """Extension: hourly windows in append mode over four batches. Each twentieth event comes two batches late, and most of
    those are dropped; windows come out once the watermark, a day behind, has passed them, and their state goes."""
    stream = _by_period(spark, d, "IF(event_id % 20 = 7, 2, 0)").withWatermark("ts", "1 day")
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return replay.run(counts, "append").select(F.col("w.start").cast("timestamp_ntz").alias("start_"), "event_type", "n")


_BATCHED = "(SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 8 AS b, event_type FROM events)"


@query("batch_window_counts", f"SELECT t AS window_end, event_type, count(*) AS n FROM {_BATCHED} e, (SELECT unnest(range(0, 6)) AS t) w WHERE t >= b AND t < b + 3 GROUP BY 1, 2")
def _(spark, d):
    """Windows of three batches at six ticks of the clock, two of them after the input's end."""
    return replay.batch_windows(_by_period(spark, d), 3, 6, lambda w: w.groupBy("event_type").agg(F.count("*").alias("n")))


@query("batch_window_slide", f"SELECT t AS window_end, count(*) AS n FROM {_BATCHED} e, (SELECT unnest(range(0, 6)) AS t) w WHERE t >= b AND t < b + 4 AND t % 2 = 0 GROUP BY 1")
def _(spark, d):
    return replay.batch_windows(_by_period(spark, d), 4, 6, lambda w: w.agg(F.count("*").alias("n")), slide=2)


def _queued(spark: SparkSession, d: str, one_at_a_time: bool) -> DataFrame:
    """Rows of each of four ticks of a queue of four frames."""
    events = table(spark, d, "events")
    queue = replay.Queue([events.where(F.col("event_id") % 4 == k) for k in range(4)], one_at_a_time)
    return coll.union_bag(*[queue.tick().agg(F.count("*").alias("n")).withColumn("tick", F.lit(t).cast("long")) for t in range(4)])


@query("queue_reemit", "SELECT t AS tick, count(*) AS n FROM events, (SELECT unnest(range(0, 4)) AS t) GROUP BY 1")
def _(spark, d):
    return _queued(spark, d, False)


@query("queue_one_at_a_time", "SELECT event_id % 4 AS tick, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return _queued(spark, d, True)


@query("custom_source_stream", "SELECT n_name AS value, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def _(spark, d):
    """A stream of one's own source: a file a trigger, decoded to lines."""
    records.register(spark)
    path = io.text_file(table(spark, d, "nation").repartition(3), F.concat_ws(",", "n_name", "n_regionkey"))
    lines = spark.readStream.format("lakefold_records").option("path", path).load()
    out = persist.fresh_path(spark, "decoded")
    running = replay.start(lines.select(F.split("value", ",").alias("p")), lambda df, k: df.write.mode("overwrite").parquet(f"{out}/{k:09d}"))
    running.process_all()
    running.stop()
    return spark.read.parquet(f"{out}/*").select(F.col("p")[0].alias("value"), F.col("p")[1].cast("long").alias("region"))


# --- iterative algorithms

_FEATURES = "SELECT n_chars / 10000.0::DOUBLE AS f0, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f1, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)"
_ROUNDS = 3


def _descent() -> str:
    steps = ["w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"]
    for k in range(_ROUNDS):
        e = "(1 / (1 + exp(-(a * f0 + b * f1 + c))) - y)"
        steps.append(f"w{k + 1} AS (SELECT any_value(a) - 0.5 * sum({e} * f0) / count(*) AS a, any_value(b) - 0.5 * sum({e} * f1) / count(*) AS b, any_value(c) - 0.5 * sum({e}) / count(*) AS c FROM x, w{k})")
    return f"WITH x AS ({_FEATURES}), " + ", ".join(steps)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 10000.0).alias("f0"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("f1"))
    return table(spark, d, "labels").join(docs, "doc_id").select("f0", "f1", F.col("quality").cast("double").alias("y"))


@query("logreg_weights", _descent() + f" SELECT round(a, 6) AS w0, round(b, 6) AS w1, round(c, 6) AS bias FROM w{_ROUNDS}")
def _(spark, d):
    m = iterative.LogisticRegression(0.5, _ROUNDS, 0.0).fit(_labelled(spark, d), ["f0", "f1"], "y")
    return spark.createDataFrame([(round(m.weights[0], 6), round(m.weights[1], 6), round(m.bias, 6))], "w0 double, w1 double, bias double")


_P = "least(greatest(1 / (1 + exp(-(a * f0 + b * f1 + c))), 1e-15), 1 - 1e-15)"


@query("logreg_loss", _descent() + f" SELECT round(avg(-(y * ln({_P}) + (1 - y) * ln(1 - {_P}))), 6) AS loss FROM x, w{_ROUNDS}")
def _(spark, d):
    data = _labelled(spark, d)
    m = iterative.LogisticRegression(0.5, _ROUNDS, 0.0).fit(data, ["f0", "f1"], "y")
    return spark.createDataFrame([(round(m.loss(data, "y"), 6),)], "loss double")


_LINES = "SELECT n_chars / 10000.0::DOUBLE AS x, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)"


def _line_rounds() -> str:
    steps = [f"p AS ({_LINES})", "w0 AS (SELECT 0.0::DOUBLE AS w)"]
    for k in range(3):
        steps.append(f"w{k + 1} AS (SELECT any_value(w) - 0.1 * sum((1 / (1 + exp(-x * w)) - y) * x) / count(*) AS w FROM p, w{k})")
    rounds = " UNION ALL ".join(f"SELECT {k} AS round, w FROM w{k}" for k in (1, 2, 3))
    return "WITH " + ", ".join(steps) + f" SELECT round, keep, round(w, 9) AS w FROM ({rounds}) r, (VALUES (true), (false)) t(keep)"


@query("line_descent", _line_rounds())
def _(spark, d):
    """Three rounds of descent over a text file, with its lines cached and not."""
    points = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    lines = io.text_lines(spark, io.text_file(points, F.concat_ws(",", (F.col("n_chars") / 10000.0).cast("string"), F.col("quality").cast("double").cast("string"))))
    found = [(k + 1, keep, round(w, 9)) for keep in (True, False) for k, w in enumerate(iterative.line_descent(lines, keep=keep))]
    return spark.createDataFrame(found, "round int, keep boolean, w double")


_EDGES = "SELECT DISTINCT 'n' || CAST(s_nationkey AS VARCHAR) AS src, 'n' || CAST(c_nationkey AS VARCHAR) AS dst FROM supplier, customer WHERE s_suppkey = c_custkey AND s_nationkey <> c_nationkey"


def _ranks(rounds: int) -> str:
    steps = [f"e AS ({_EDGES})", "v AS (SELECT src AS page FROM e UNION SELECT dst FROM e)", "o AS (SELECT src, count(*) AS n FROM e GROUP BY src)", "r0 AS (SELECT page, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)"]
    for k in range(rounds):
        steps.append(
            f"r{k + 1} AS (SELECT v.page, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * (coalesce(m.s, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE page NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM v)) AS rank"
            f" FROM v LEFT JOIN (SELECT e.dst, sum(r.rank / o.n) AS s FROM e JOIN o ON e.src = o.src JOIN r{k} r ON r.page = e.src GROUP BY e.dst) m ON m.dst = v.page)"
        )
    return "WITH " + ", ".join(steps) + f" SELECT page, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank", _ranks(5))
def _(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    edges = s.join(c, F.expr("s_suppkey = c_custkey AND s_nationkey <> c_nationkey")).select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst")).distinct()
    return iterative.page_rank(edges, iterations=5, tolerance=0.0, normalise=False).select("page", F.round("rank", 9).alias("rank"))


@query("logreg_tolerance", "SELECT 2 AS rounds")
def _(spark, d):
    """A tolerance that the first round meets at once: the change is looked at from the second round on."""
    m = iterative.LogisticRegression(0.5, 50, 1e9).fit(_labelled(spark, d), ["f0", "f1"], "y")
    return spark.createDataFrame([(m.rounds,)], "rounds int")


# --- the same two run with their defaults, to convergence or their last round; unrolled SQL of 50 rounds is too slow


@query("logreg_default_rounds")
def _(spark, d):
    data = _labelled(spark, d)
    m = iterative.LogisticRegression().fit(data, ["f0", "f1"], "y")
    return spark.createDataFrame([(m.weights[0], m.weights[1], m.bias, m.loss(data, "y"))], "w0 double, w1 double, bias double, loss double")


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst), distinct: customer to each supplier of its orders, supplier to its nation, nation to each of its customers."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    sold = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey"))
    edges = sold.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    edges = edges.union(s.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))
    return edges.union(c.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey"))).distinct()


@query("pagerank_converged")
def _(spark, d):
    return iterative.page_rank(trade_edges(spark, d)).select("page", "rank")


# --- extensions: built in, beyond the inventory's present rows

sql("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
sql("count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
sql("global_aggregate", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
sql("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
sql("order_limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
sql("semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
sql("anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey")
sql("rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS r FROM orders")


@query("running_sum", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s FROM lineitem")
def _(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w).alias("s"))


sql("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("case_in_like_between", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 's' WHEN p_size IN (20, 30) THEN 'm' ELSE 'l' END AS k FROM part WHERE p_type LIKE '%A%' AND p_brand IS NOT NULL")
sql("subquery_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, n FROM customer JOIN big ON c_custkey = o_custkey WHERE n > (SELECT avg(n) FROM big)")
