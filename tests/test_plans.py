"""Physical plans: what is pruned, pushed, broadcast and shuffled."""

import re

import pytest

import __spark_entry__ as job

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return job.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_ranking_shuffles_no_vector(spark):
    text = plan(spark, "topk_search_batch")
    assert text.count("WindowGroupLimit") == 2
    above = text[: text.index("MapInArrow")]
    assert above.count("Exchange hashpartitioning(query_id") == 1 and "embedding" not in above
    below = text[text.index("MapInArrow") :]
    # only the narrow document table is grouped by its key; no chunk is moved
    moved = re.findall(r"Exchange hashpartitioning\(document_id[^\n]*\n([^\n]*)", below)
    assert all("HashAggregate(keys=[document_id" in line and "partial_min(collection_id" in line for line in moved)


def test_single_request_takes_ordered(spark):
    assert "TakeOrderedAndProject" in plan(spark, "topk_search_all")


@pytest.mark.parametrize(
    "name, columns",
    [("cutting_text", "doc_id:bigint,text:string"), ("mean_pool", "embedding:array<float>,label:int"),
     ("creation_stamps", "event_id:bigint,ts:timestamp_ntz,user_id:bigint"), ("normalize_filename", "doc_id:bigint")],
)
def test_only_needed_columns_are_read(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, name)


@pytest.mark.parametrize("name", ["cutting_text", "split_words", "taille_chunk", "extract_txt", "slug_update", "check_permission", "update_users"])
def test_no_python_in_the_jvm_operators(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("name", ["cutting_text", "embed_chunks", "extract_html", "slug_create"])
def test_row_wise_operators_do_not_shuffle(spark, name):
    text = plan(spark, name)
    # a table of a single file is spread over the cores first, see Bindings.spread
    assert text.count("Exchange") == text.count("REPARTITION_BY_NUM")


def test_audit_counts_before_joining(spark):
    text = plan(spark, "access_audit")
    assert "partial_count(1)" in text and text.index("Join") < text.index("partial_count(1)")


def test_bucketed_tables_join_without_shuffle(spark):
    from passagelake.session import scratch_path
    from passagelake.sources.sinks import save_bucketed

    chunks = spark.range(100).selectExpr("id AS chunk_id", "id % 10 AS document_id")
    documents = spark.range(10).selectExpr("id AS document_id", "1 AS collection_id")
    try:
        save_bucketed(chunks, "bucketed_chunks", "document_id", 4, scratch_path(spark, "b"))
        save_bucketed(documents, "bucketed_documents", "document_id", 4, scratch_path(spark, "b"))
        joined = spark.table("bucketed_chunks").hint("merge").join(spark.table("bucketed_documents"), "document_id")
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text and joined.count() == 100
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_chunks")
        spark.sql("DROP TABLE IF EXISTS bucketed_documents")
