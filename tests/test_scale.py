"""Plans that have to hold at scale."""

import os

import pytest

import __spark_entry__ as contract
from chatterlens.plans import questions as qu
from chatterlens.sources.corpus import read_bucketed, save_bucketed

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_tables_join_without_shuffle(spark, small_corpus, tmp_path, no_broadcast):
    save_bucketed(small_corpus, "bk", 4, str(tmp_path))
    g = read_bucketed(spark, "bk")
    try:
        assert "Exchange" not in plan(g.facts(None, "content"))
        assert "Exchange" not in plan(g.classified_messages("content"))
        assert sorted(g.facts().collect()) == sorted(small_corpus.facts().collect())
        assert qu.top_complainers(g).collect() == qu.top_complainers(small_corpus).collect()
    finally:
        for name in ("messages", "users", "message_taxonomy", "extracted_entities", "embeddings_reference"):
            spark.sql(f"DROP TABLE IF EXISTS bk_{name}")


def test_reads_only_needed_columns(spark, small_corpus, tmp_path):
    small_corpus.messages.write.parquet(str(tmp_path / "messages"))
    from dataclasses import replace

    g = replace(small_corpus, messages=spark.read.parquet(str(tmp_path / "messages")))
    text = plan(g.facts(["questions"]).groupBy("author_id").count())
    assert "ReadSchema: struct<id:string,author_id:string>" in text
    from chatterlens.operators.tables import messages_by_timerange

    assert "GreaterThanOrEqual(timestamp,5)" in plan(messages_by_timerange(g.messages, 5, 9))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", [
    "top_complainers", "co_requested", "similar_users", "feature_and_integration_pairs", "vector_search", "opportunity_themes",
    "questions_then_complaints", "thread_depth_by_topic", "wants_integration_and_auth", "cross_category_keywords", "davies_bouldin",
])
def test_no_products(spark, name, no_broadcast):
    text = plan(contract.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text and "BatchEvalPython" not in text


def formatted(spark, df) -> str:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", ["taxonomy_samples", "cluster_samples", "cluster_members", "noise_report"])
def test_whole_texts_stay_where_they_are_read(spark, name, no_broadcast):
    # The tables of the registered queries build ``content`` from a join; a written table shows what the operator adds.
    from checks.adapter import spark_corpus
    from chatterlens.operators import clusters as cl
    from chatterlens.operators import tables as tb

    g = spark_corpus(spark, FOLDER)
    messages = spark.read.schema(g.messages.schema).parquet(written(spark, g.messages))
    labels = g.message_clusters.select("message_id", "cluster_id")
    df = {
        "taxonomy_samples": lambda: tb.taxonomy_samples(messages, g.message_taxonomy, 1),
        "cluster_samples": lambda: cl.cluster_samples(labels, messages),
        "cluster_members": lambda: cl.cluster_members(labels, messages),
        "noise_report": lambda: cl.noise_report(labels, messages),
    }[name]()
    exchanges = [block for block in formatted(spark, df).split("\n\n") if "Exchange" in block.split("\n")[0]]
    assert exchanges and not any("content#" in block for block in exchanges)


def written(spark, df) -> str:
    from checks.cases import work_folder

    path = f"{work_folder(spark)}/messages"
    df.write.parquet(path)
    return path


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", [
    "extract_keywords", "extract_tools_and_pains", "classify_by_rules", "auto_categories", "cross_category_keywords", "opportunity_themes",
    "theme_top_keywords", "report_top_keywords", "report_insights", "embed_messages",
])
def test_words_are_found_without_python(spark, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
