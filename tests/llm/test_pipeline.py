"""Every stage of the pipeline on rows with nulls, empty texts, repeated rows and no rows."""

import pytest

import corpus_pipeline
from sigspark.llm.common import table, written

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, empty):
    whole = table(spark, DATA, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (900_003, " \t", "en", "s", 2)],
                                whole.schema)
    docs = whole.where("false") if empty else whole.union(whole.limit(3)).union(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, DATA), "stage")
        assert docs.columns == whole.columns, name
        assert docs.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").where("doc_id is not null").count() == 0
    ids = written(corpus_pipeline.STAGES[-1][1](spark, docs, DATA), "stage")
    assert ids.count() == docs.count() and (empty or docs.count() > 20)


def test_near_dedup_moves_no_texts(spark):
    """What is dropped goes to the tasks of the documents, which stay where they are."""
    docs = written(table(spark, DATA, "documents").selectExpr("doc_id", "text", "lang", "source", "n_chars"), "stage")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = corpus_pipeline.near_dedup(spark, docs, DATA)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        assert 0 < left.count() < docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
