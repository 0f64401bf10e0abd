"""Texts stay where they are where a stage drops a few known rows."""

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_decontamination_sends_the_rows_to_drop(spark):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "20000")
    try:
        left = corpus_pipeline.decontamination_stage(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
        plan = left._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert 0 < left.count() < spark.read.parquet(f"{DATA}/documents.parquet").count()
    finally:
        spark.conf.set(setting, before)
