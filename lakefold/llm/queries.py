"""The thin queries opN_* over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm import decontaminate, embedding_dedup, lm_scoring, mixing, near_dedup, quality, sharding, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)
    return found.withColumnRenamed("id", "doc_id")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.embedding_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score_texts(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)
    return found.drop("kept").withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_mixing_sources": op3_mixing_sources,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_toxicity": op10_toxicity,
}

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = "unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s"


def _shingled(table: str, key: str) -> str:
    words = rf"regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w"
    return f"SELECT DISTINCT {key}, s FROM (SELECT {key}, {_SHINGLES} FROM (SELECT {key}, {words} FROM {table}))"


#: Bytes of a piece whose windows are cut out of it, as cutting them out of a long text takes time for all bytes before.
_PIECE = 512


def _repeated(name: str, length: int) -> str:
    """Tables name_w (places of strings that start more than once) and name_s (first byte and end of the runs that they cover); texts are hex."""
    return f"""
        {name}_p AS (SELECT doc_id, c, substr(h, {2 * _PIECE} * c + 1, {2 * (_PIECE + length - 1)}) AS piece FROM (SELECT doc_id, h, unnest(range(0, n // {_PIECE} + 1)) AS c FROM b)),
        {name}_a AS (SELECT doc_id, {_PIECE} * c + p AS p, md5(substr(piece, 2 * p + 1, {2 * length})) AS m FROM (SELECT doc_id, c, piece, unnest(range(0, least({_PIECE}, len(piece) // 2 - {length - 1}))) AS p FROM {name}_p)),
        {name}_w AS (SELECT doc_id, p FROM {name}_a SEMI JOIN (SELECT m FROM {name}_a GROUP BY m HAVING count(*) > 1) USING (m)),
        {name}_g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {length} THEN 0 ELSE 1 END AS fresh FROM {name}_w)),
        {name}_s AS (SELECT doc_id, k, min(p) AS s, max(p) + {length} AS e FROM {name}_g GROUP BY doc_id, k)"""


ORACLE_SQL: dict[str, str] = {
    "op9_suffix_array_dedup": f"""
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, len(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents), {_repeated("long", suffix_dedup.LENGTH)}, {_repeated("short", suffix_dedup.PASSAGE)},
        r AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM long_s GROUP BY doc_id), q AS (SELECT doc_id, sum(e - s) AS shared FROM short_s GROUP BY doc_id),
        o AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS lo, s AS hi FROM long_s UNION ALL SELECT b.doc_id, coalesce(max(e), 0), any_value(n) FROM b LEFT JOIN long_s USING (doc_id) GROUP BY b.doc_id),
        t AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS kept FROM o JOIN b USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
            CAST(coalesce(shared, 0) AS BIGINT) AS n_shared, sha256(unhex(kept)) AS kept_sha256
        FROM b JOIN t USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "op1_benchmark_decontamination": f"""
        WITH d AS ({_shingled("documents", "doc_id")}), q AS ({_shingled("benchmark", "item_id")}),
        n AS (SELECT item_id, count(*) AS item_shingles FROM q GROUP BY item_id)
        SELECT doc_id, item_id, item_shingles, count(*) AS hits, count(*)::DOUBLE / item_shingles AS containment
        FROM d JOIN q USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING 100 * count(*) >= 80 * item_shingles""",
    "op2_minhash_near_dedup": f"""
        WITH RECURSIVE s AS ({_shingled("documents", "doc_id")}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        k AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
        l AS (SELECT x AS a, y AS b FROM k UNION ALL SELECT y, x FROM k),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS lo FROM r GROUP BY a)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(lo, doc_id)) AS component_id, doc_id <= coalesce(lo, doc_id) AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id""",
    "op3_mixing_sources": r"""
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
            CAST('0x' || substr(md5('17/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST([1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS DOUBLE) AS w FROM s),
        o AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (down ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
            sum(w) OVER (down ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest, row_number() OVER down AS n
            FROM w WHERE source_size > 0 WINDOW down AS (ORDER BY w / source_size DESC, source IS NULL, source)),
        f AS (SELECT n, rest, w_rest FROM o WHERE w * rest / w_rest <= 3 * source_size ORDER BY n LIMIT 1),
        t AS (SELECT w.source, w.source_size, CASE WHEN w.source_size = 0 THEN 0.0::DOUBLE WHEN f.n IS NULL OR o.n < f.n THEN 3 * CAST(w.source_size AS DOUBLE) ELSE w.w * f.rest / f.w_rest END AS target
            FROM w LEFT JOIN o ON w.source IS NOT DISTINCT FROM o.source LEFT JOIN f ON true),
        p AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget,
            CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
        SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        m AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h)
        SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
            CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
        FROM p LEFT JOIN m ON p.h = m.h""",
    "op7_embedding_near_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS lo FROM r GROUP BY a), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
        SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(lo, vec_id)) AS component_id, vec_id <= coalesce(lo, vec_id) AS kept
        FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
}
