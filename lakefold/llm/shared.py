"""What the operators share: cutting lineage, size-checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a side may have to be broadcast; beyond it, joins shuffle.
BROADCAST_BYTES = 16 << 20

#: Edges of a node from which it is a hub, at least.
HUB_EDGES = 1000
#: Distinct edges that one task may join into components (8 MB of them); beyond it, rounds over all partitions.
LOCAL_EDGES = BROADCAST_BYTES // 32
#: Rows of an Arrow batch: ten times fewer than Spark's default, as a row here is a whole text.
BATCH_ROWS = 1024

#: Java's form of the words that every operator here counts.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where the session names none, as in tests, a folder of our own is made and
    set as the checkpoint folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if at is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lakefold-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def short_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows between Spark and Python in this session, unless it has set a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


_paths: list[str] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    _paths.append(f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}")
    return _paths[-1]


def made_since(mark: int) -> list[str]:
    """The paths that fresh_path has given since it had given `mark` of them; made_since(0) is all."""
    return _paths[mark:]


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes what is stored at the paths, on any file system that Spark knows: only once nothing reads it any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def uri_of(path: str) -> str:
    """path as a URI that pyarrow opens: file:/x, as Hadoop writes it, is file:///x."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else f"file://{path}"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path within it."""
    return fs.FileSystem.from_uri(uri_of(uri))


def cut(df: DataFrame) -> DataFrame:
    """df by reliable checkpoint: computed once, read from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet below the shared folder and read again."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, n: int | None = None) -> DataFrame:
    """df, marked for broadcast if its counted rows of row_bytes stay within limit; n: its rows, where they were counted before.

    df must be cheap to count (stored or checkpointed). Larger ones are returned
    as they are, and the join shuffles.
    """
    return F.broadcast(df) if (df.count() if n is None else n) * row_bytes <= limit else df


def spread(df: DataFrame, rows_each: int, least: int = 8, n: int | None = None) -> int:
    """A number of partitions that grows with df's rows; n as in small()."""
    return max(least, -(-(df.count() if n is None else n) // rows_each))


def held_out(doc_id: str, mod: int) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by mod; null ids: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == 2, F.lit(False))


def least_of_components(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of the component of each) of the graph of these edges.

    A root that an edge links to a lesser root is hung below the least of them, then all paths are shortened, until no edge
    links two roots.
    """
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = at[: hi.size], at[hi.size :]
    root = np.arange(nodes.size)
    while a.size:
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, above := root[root]):
            root = above
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[root]


def _local_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column("hi").to_numpy(), b.column("lo").to_numpy()) for b in batches if b.num_rows]
    if ends:
        nodes, least = least_of_components(*(np.concatenate(x) for x in zip(*ends, strict=True)))
        for at in range(0, nodes.size, 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65536]) for x in (nodes, least)], ["node", "component"])


def connected_components(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """Components of the graph of (src, dst), whole numbers, as (node, component).

    component is the least node of the component. Up to local_edges distinct
    edges (LOCAL_EDGES if None) are joined by one task: rounds over all
    partitions take the driver far more memory than such a graph. A larger graph
    alternates large-star and small-star steps until its edges are stars, or few
    enough for one task. A node's least neighbour is
    combined on the map side; the edges of a hub then meet it by broadcast, as
    only few nodes can have that many edges, and those of the others by a
    shuffle. Rows with a null end are left out; so are nodes without an edge to
    another node.
    """
    local_edges = LOCAL_EDGES if local_edges is None else local_edges
    now = cut(
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )
    seen = _mark(now)
    while seen[0] > local_edges:
        large = _large_star(now, seen[0]).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rest = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = cut(least.select("hi", F.col("m").alias("lo")).union(rest).distinct())
        if (then := _mark(now)) == seen:
            break
        seen = then
    else:
        kind = now.schema["hi"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_local_components, f"node {kind}, component {kind}")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's greater neighbours, linked to the least of the node and its neighbours; n: number of edges."""
    both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    many = max(HUB_EDGES, 2 * n // (BROADCAST_BYTES // 32))  # so that at most BROADCAST_BYTES // 32 nodes have more
    if n > many:
        hubs = cut(least.where(F.col("degree") > many).select("u", "m"))
        if hubs.limit(1).count():
            hubs = F.broadcast(hubs)
            others = both.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("degree") <= many), "u")
            both = others.select("u", "v", "m").union(both.join(hubs, "u").select("u", "v", "m"))
            return both.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free hash of the edges: equal marks mean equal edges."""
    n, h = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first()
    return n, h or 0
