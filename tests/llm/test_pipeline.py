"""The pipeline stage by stage on the smallest tables, and what its run returns."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lakefold.llm import decontaminate, near_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF).cache()
        kept.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
        if k == 1:
            assert all(r.kept for r in near_dedup.near_duplicates(docs).collect())
        if k == 2:
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if k == 4:
            assert Counter(r.doc_id for r in docs.collect()) == Counter(r.doc_id for r in before.collect())
    assert kept[1] < kept[0] and kept[2] < kept[1] and kept[5] == kept[4] > 0
    assert corpus_pipeline.run(spark, SF).count() == kept[5]


def test_near_dedup_stage_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (2, b)]
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(r.text for r in got) == [a, b, c] and {r.doc_id for r in got if r.text in (a, c)} == {1, 2}
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame([(1, a), (2, a), (3, b), (4, "")], "doc_id long, text string"), SF).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 4]
    blank = [(1, ""), (1, ""), (2, ""), (None, None), (None, None), (None, "")]
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(blank, "doc_id long, text string"), SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("1", ""), ("2", ""), ("None", ""), ("None", "None")]


ODD = [(1, None, None, None), (1, None, None, None), (None, "", "s", "x"), (None, None, None, None), (2, "one", "s", "de"), (2, "ONE two three four five six", None, "en"), (3, "w " * 300_000, "s", "en"), (3, "w " * 300_000, "s", "en")]


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    """Each stage over null, empty, very long and repeated rows, with columns of its own names, and over no rows."""
    odd = spark.createDataFrame([(*r, 0.5, True, 7, 8, "k") for r in ODD], "doc_id long, text string, source string, lang string, score double, kept boolean, size long, shard int, key string")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (odd, odd.limit(0)):
            got = stage(spark, docs, SF)
            rows = got.collect()
            assert k == 4 or got.columns == odd.columns, name
            assert k == 4 or all(r.score == 0.5 and r["key"] == "k" for r in rows), name
            assert len(rows) == {2: docs.count(), 4: docs.count()}.get(k, len(rows)), name


def test_quality_stage_keeps_a_score_column(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_filter(spark, docs, SF)
    scored = corpus_pipeline.quality_filter(spark, docs.withColumn("score", F.lit(0.123)), SF)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.collect()} and {r.score for r in scored.collect()} == {0.123}
