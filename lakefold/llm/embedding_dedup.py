"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are normalised and turned into the principal axes of a bounded sample,
largest variance first. Vectors within the threshold differ little in every
axis, so the first two axes make a grid whose cells are compared with
themselves and half of their neighbours only. A cell is dealt into blocks as
large as a task may hold, and only blocks meet: a vector is sent once to each
block that its cell must meet, however many tiles that has. Within a task, a
block is compared in tiles of bounded size. In a tile, products are accumulated
over leading dimensions block by block; what the rest can add is bounded by the
product of the suffixes' norms, and pairs whose cosine can no longer reach the
threshold stop. Survivors get their cosine in double precision from the original
components.

Equal vectors are collapsed first and carry their number, so a group of copies
costs one vector. A tile returns counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.llm.shared import connected_components, cut, short_batches, small

#: Vectors that the axes are fitted on, at most, and vectors of a tile's side.
SAMPLE, TILE = 4096, 1024
#: Components of a block of vectors.
BLOCK_VALUES = 1 << 21
#: Leading dimensions after which the bound is tried.
STEPS = (4, 8, 16, 32, 64, 128, 256, 512)


class Axes:
    """Principal axes (columns) by falling variance."""

    def __init__(self, sample: np.ndarray):
        if sample.size:
            _, _, vt = np.linalg.svd(sample.T @ sample)
            self.turn = vt.T
        else:
            self.turn = np.eye(max(1, sample.shape[1]))


def linked_pairs(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the pairs with the cosine or more; a, b: original vectors, ra, rb: unit vectors in axes.

    same: a and b are one list, and only i < j counts.
    """
    dim = ra.shape[1]
    slack = 1e-9
    first = min(STEPS[0], dim)
    sum_ = ra[:, :first] @ rb[:, :first].T
    ta, tb = _suffix_norms(ra), _suffix_norms(rb)
    open_ = sum_ + ta[:, first][:, None] * tb[:, first][None, :] >= cosine - slack
    if same:
        open_ &= np.triu(np.ones(open_.shape, dtype=bool), 1)
    i, j = np.nonzero(open_)
    part = sum_[i, j]
    for lo, hi in zip((first, *STEPS[1:]), (*STEPS[1:], dim), strict=True):
        hi = min(hi, dim)
        if hi <= lo or not i.size:
            continue
        part = part + _products(ra, rb, i, j, lo, hi)
        keep = part + ta[i, hi] * tb[j, hi] >= cosine - slack
        i, j, part = i[keep], j[keep], part[keep]
    if i.size:
        na, nb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
        keep = _products(a, b, i, j, 0, a.shape[1]) / (na[i] * nb[j]) >= cosine
        i, j = i[keep], j[keep]
    return i, j


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, lo: int, hi: int) -> np.ndarray:
    out = np.empty(i.size)
    for k in range(0, i.size, 65536):
        out[k : k + 65536] = np.einsum("ij,ij->i", a[i[k : k + 65536], lo:hi], b[j[k : k + 65536], lo:hi])
    return out


def _suffix_norms(r: np.ndarray) -> np.ndarray:
    """norms[:, k]: norm of the dimensions from k on."""
    squares = np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate((squares, np.zeros((r.shape[0], 1))), axis=1))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _turned(v: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Unit vectors in axes; those of another length than the axes keep their own."""
    return _unit(v) @ turn if v.shape[1] == turn.shape[0] else _unit(v)


def _cells(turn: np.ndarray, side: float):
    """mapInArrow function: adds the cell (x, y) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.zeros((batch.num_rows, 2), dtype=np.int32)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                r = _turned(_matrix(batch.column("v").take(pa.array(own))), turn)[:, :2]
                grid[own, : r.shape[1]] = np.floor(r / side)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grid[:, 0].copy()), pa.array(grid[:, 1].copy())], [*batch.schema.names, "x", "y"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _tiles(turn: np.ndarray, cosine: float, tile: int):
    """mapInArrow function: rows sorted by (cell, block, home first) -> (gid, other, n): links' weight, and edges."""

    def ready(rows: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(rows).combine_chunks()
        v = _matrix(t.column("v").chunk(0))
        return t.column("gid").to_numpy(), t.column("n").to_numpy(), v, _turned(v, turn)

    def links(a: tuple, b: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        i, j = linked_pairs(a[2], b[2], a[3], b[3], cosine, same)
        if not i.size:
            return
        jj = j + (0 if same else a[0].size)
        weight = np.zeros(a[0].size + b[0].size, dtype=np.int64)
        np.add.at(weight, i, b[1][j])
        np.add.at(weight, jj, a[1][i])
        gids = np.concatenate((a[0], b[0]))
        root = np.arange(gids.size)
        while True:  # spread the least index along the links: a forest of stars
            before = root.copy()
            low = np.minimum(root[i], root[jj])
            np.minimum.at(root, i, low)
            np.minimum.at(root, jj, low)
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(gids[some]), pa.array(gids[root[some]]), pa.array(weight[some])], ["gid", "other", "n"])

    def met(a: tuple, b: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        for i in range(0, a[0].size, tile):
            for j in range(i if same else 0, b[0].size, tile):
                yield from links(tuple(x[i : i + tile] for x in a), tuple(x[j : j + tile] for x in b), same and i == j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, home = None, [], None

        def settled() -> Iterator[pa.RecordBatch]:
            """The home block is whole: compared with itself."""
            nonlocal waiting, home
            if waiting:
                home, waiting = ready(waiting), []
                yield from met(home, home, True)

        for batch in batches:
            marks = np.stack([batch.column("cell").to_numpy(), batch.column("t").to_numpy(), batch.column("visitor").to_numpy(zero_copy_only=False).astype(np.int64)])
            bounds = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), batch.num_rows] if batch.num_rows else [0]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if key != (own := (marks[0, lo], marks[1, lo])):
                    yield from settled()
                    key, home = own, None
                if not marks[2, lo]:
                    waiting.append(batch.slice(lo, hi - lo))
                    continue
                yield from settled()
                if home is not None:
                    yield from met(home, ready([batch.slice(lo, hi - lo)]), False)
        yield from settled()

    return run


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, tile: int = TILE, block_values: int = BLOCK_VALUES) -> DataFrame:
    """One row (id, n_links, component_id, kept) per row of vectors.

    Rows of equal labels are linked when their cosine, in double precision, is
    at least `cosine`. Null labels, null or zero vectors, vectors with a null or
    non-finite component and null ids link with nothing; vectors are compared
    with those of their own length only. Equal vectors are
    linked with each other. Repeated ids are one node, each row with its own
    count. Other columns are ignored; an empty table gives no rows.
    """
    short_batches(vectors.sparkSession)
    v = F.col("v")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    fine = F.size("v") > 0
    for bad in (F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), ~F.exists(v, lambda x: x != 0)):
        fine = fine & ~bad
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False))
    rows = cut(rows.withColumn("k", F.when(good, F.struct("label", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.size("v").alias("dim")))))
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    groups = cut(groups.select(F.monotonically_increasing_id().alias("gid"), "node", "k.label", "k.dim", "n", "v", "k"))
    links = cut(_links(groups, cosine, sample, tile, block_values))
    nodes = groups.select("gid", "node")  # groups of one id are one node, but have links of their own
    edges = links.join(nodes.toDF("gid", "src"), "gid").join(nodes.toDF("other", "dst"), "other")
    comps = connected_components(edges.select("src", "dst")).toDF("node", "component")
    counts = links.groupBy("gid").agg(F.sum("n").alias("linked"))
    named = groups.select("k", "gid", "node", "n").join(counts, "gid", "left").join(comps, "node", "left")
    named = named.select("k", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.select("id", "k").join(named, "k", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def _links(groups: DataFrame, cosine: float, sample: int, tile: int, block_values: int) -> DataFrame:
    """(gid, other, n): for each group the weight of its links in a tile, and a group that it is connected to."""
    some = groups.orderBy(F.xxhash64("node", "label")).limit(sample).select("v", "dim").toArrow()
    dims = some.column("dim").to_numpy()
    usual = int(np.bincount(dims).argmax()) if dims.size else 1  # vectors of other lengths keep their own axes
    same = some.filter(pa.array(dims == usual)).column("v").combine_chunks()
    same = same.chunk(0) if isinstance(same, pa.ChunkedArray) else same
    axes = Axes(_unit(_matrix(same)) if dims.size else np.zeros((0, 1)))
    side = float(np.sqrt(max(1e-9, 2 - 2 * cosine))) * (1 + 1e-6)
    vector = dict(groups.dtypes)["v"]
    placed = cut(groups.select("gid", "label", "dim", "n", "v").mapInArrow(_cells(axes.turn, side), f"gid long, label string, dim int, n long, v {vector}, x int, y int"))
    place = ["label", "dim", "x", "y"]
    rows_each = F.greatest(F.lit(1), F.floor(F.lit(block_values) / F.col("dim")))
    cells = cut(placed.groupBy(*place).agg(F.count("*").alias("rows")).select(*place, F.ceil(F.col("rows") / rows_each).cast("int").alias("blocks"), F.monotonically_increasing_id().alias("cell")))
    cells = small(cells, 96)
    moves = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in moves])).alias("m")
    # a vector visits its own cell's later blocks and all blocks of half the neighbouring cells
    sent = placed.select("*", steps).select("gid", "label", "dim", "n", "v", F.expr("x + m.dx").alias("x"), F.expr("y + m.dy").alias("y"), F.expr("m.dx = 0 AND m.dy = 0").alias("home"))
    sent = sent.join(cells, place).withColumn("mine", F.pmod(F.xxhash64("gid"), F.col("blocks").cast("long")).cast("int"))
    sent = sent.withColumn("t", F.explode(F.expr("sequence(IF(home, mine, 0), blocks - 1)")))
    blocks = sent.select("cell", "t", (~F.col("home") | (F.col("t") != F.col("mine"))).alias("visitor"), "gid", "n", "v")
    parts = max(16, -(-placed.count() // 500))
    return blocks.repartition(parts, "cell", "t").sortWithinPartitions("cell", "t", "visitor").mapInArrow(_tiles(axes.turn, cosine, tile), "gid long, other long, n long")
