"""Every stage of the pipeline on tables without rows, and on rows with nulls and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_without_rows(spark, table, name, stage):
    out = stage(spark, table.limit(0), FOLDER)
    assert out.count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == table.columns


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[1:-1])
def test_stage_with_nulls_and_clashing_names(spark, table, name, stage):
    """Null ids, null and empty texts stay, repeated rows with one id count as one document; other columns stay too."""
    few = table.where("doc_id < 40").select("*", F.lit("k").alias("kept"), F.lit(1).alias("n_words"))
    odd = few.limit(1).select(
        *[F.lit(None).cast(field.dataType).alias(field.name) for field in few.schema.fields]
    )
    empty = few.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.lit("").alias("text"), *few.columns[2:])
    out = stage(spark, few.unionByName(odd).unionByName(empty), FOLDER)
    assert out.columns == few.columns
    assert out.where("doc_id IS NULL AND text IS NULL AND kept IS NULL").count() == 1
    assert out.where("doc_id = 1000000 AND text = '' AND kept = 'k' AND n_words = 1").count() == 1
