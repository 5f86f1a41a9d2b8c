"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key, the first 60 bits of an MD5. Within its source, documents are taken in
the order of their keys; the words before a document are a distributed prefix
sum: sums of buckets of the key's range, a running sum over the buckets, and a
running sum within each bucket. A source is cut at its exact budget of words:
whole epochs first, then the documents below the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.llm.shared import WORD, cut, small

#: Documents of a bucket, about; buckets are a power of two, so that a key's top bits name one.
BUCKET_ROWS = 4096
SEED = 17
KEY_BITS = 60


def key_of(id_col: str, text_col: str) -> Column:
    """A number of KEY_BITS bits that depends on id and text alone; nulls are like empty ones."""
    said = F.concat_ws("/", F.lit(str(SEED)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, KEY_BITS // 4), 16, 10).cast("long")


def words_of(text: str) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def capped_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted shares of all words, none above repeat times its source.

    Weights go to the sources by code point, null last, repeating. Sources are
    capped in the order of weight / size, largest first: when the sources before
    are capped, one whose share of what is left passes its cap is capped too. As
    the share of the others only grows by a cap, that order finds the same
    sources as resharing the excess again and again. Sources, which are few, are
    ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    w = sizes.withColumn("w", weight)
    down = Window.orderBy((F.col("w") / F.col("source_size")).desc_nulls_last(), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    w = w.where("source_size > 0").withColumns({
        "left": F.sum("source_size").over(everything) - repeat * F.coalesce(F.sum("source_size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_left": F.sum("w").over(down.rowsBetween(0, Window.unboundedFollowing)),
        "n": F.row_number().over(down),
    }).union(w.where("source_size = 0").selectExpr("*", "0 AS `left`", "1D AS w_left", "0 AS n"))
    w = w.withColumn("capped", (F.col("n") > 0) & (F.col("w") * F.col("left") / F.col("w_left") > repeat * F.col("source_size")))
    free = ~F.col("capped") & (F.col("n") > 0)
    first = F.min(F.when(free, F.struct("n", "left", "w_left"))).over(everything)
    share = F.when(F.col("n") == 0, 0.0).when(F.col("n") < F.coalesce(first["n"], F.lit(1 << 30)), repeat * F.col("source_size").cast("double"))
    return w.withColumn("target", share.otherwise(F.col("w") * first["left"] / first["w_left"])).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row (id, source, key, size, source_size, target, taken) per row of docs.

    key is the hash-random key, size the number of words, target the words that the mix wants of the
    row's source, taken the words that it takes of the row, over all epochs: the
    document at the cut gives only its words before it. The taken words of a
    source are its target, rounded. Null sources are one source; null and empty
    texts have size and taken 0. The order depends on id and text alone, so
    reruns agree; equal rows may trade places. Other columns are ignored. An
    empty table gives no rows.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, repeat, bucket_rows).drop("copies")


def _mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """mix_sources with copies: the whole copies that come nearest to taken, for a row without words its source's epochs and one more before the cut."""
    keyed = cut(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words_of(text_col).alias("size"), key_of(id_col, text_col).alias("key"))
    )
    bits = max(1, (-(-keyed.count() // bucket_rows)).bit_length())
    keyed = keyed.withColumn("bucket", F.shiftright("key", KEY_BITS - bits))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))))
    targets = capped_targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, repeat)
    plan = cut(sums.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.source", "s.bucket", "s.before", "t.source_size", "t.target"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.alias("k").join(plan.alias("p"), F.expr("k.source <=> p.source AND k.bucket = p.bucket")).select("k.*", "p.before", "p.source_size", "p.target")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before") - F.col("inside")))
    taken = (epochs * F.col("size") + part).cast("long")
    whole = F.when(F.col("size") > 0, F.round(taken / F.col("size"))).otherwise(epochs + (rest > F.col("before") + F.col("inside")).cast("long"))
    return placed.select("id", "source", "key", "size", "source_size", "target", taken.alias("taken"), whole.cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs' own columns: each document as often as whole copies of it come nearest to its taken words.

    Documents without words are repeated as their source is: its whole epochs, and once more where their key comes before
    its cut. A source without any words has no epoch, so its documents are left out.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = _mixed(docs, **options)
    times = found.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.max("copies").alias("__times")).where("__times > 0")
    times = small(cut(times), 40)
    joined = docs.join(times, F.col(id_col).eqNullSafe(F.col("__id")) & (key_of(id_col, text_col) == F.col("__key")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])
