"""The pipeline's stages one after the other."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from spanloom.llm.common import Stash, table


@pytest.mark.parametrize("rows", [None, 0])
def test_stages(spark, rows):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").withColumn("gone_id", F.lit(1))
    docs = docs if rows is None else docs.limit(rows)
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = Stash(spark, "test").put(stage(spark, docs, sf))
        if name == "best-fit packing":
            assert out.select("doc_id").distinct().count() == docs.count()
        else:
            assert out.columns == columns and out.count() <= docs.count()
            docs = out
        if name == "personal data" and rows is None:
            assert out.where(F.col("text").rlike(r"@[a-z0-9]+\.example|\+1 \(\d{3}\)")).count() == 0
    assert rows == 0 or 0 < docs.count() < n


def test_a_rare_source_does_not_shrink_the_sample(spark):
    rows = [(i, "some words of one topic " * 4, "hot" if i % 3 == 0 else f"s{i % 19}", "en") for i in range(6000)]
    docs = spark.createDataFrame([*rows, (6000, "some words of one topic", "odd", None)], "doc_id long, text string, source string, lang string")
    out = corpus_pipeline.mix_sources(spark, docs, "").toPandas()
    assert abs(len(out) / 6001 - corpus_pipeline.MIXED_SHARE) < 0.03 and "odd" in set(out.source)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048 and len(out) > 50
