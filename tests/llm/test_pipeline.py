"""The pipeline's stages against brute force, each on its own input."""

import public_tokenizers
from brute import base_counts, jaccard_components
from test_packing import check
from test_search_and_urls import plain_lines

import corpus_pipeline
from chatterlens.llm import quality, toxicity
from chatterlens.llm.base import table


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, small).cache()
    verdicts = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality(docs).collect()}
    assert good.columns == columns and set(texts(good)) == {i for i, t in texts(docs).items() if not base_counts(t)[5] and verdicts[i][1]}
    calm = stages["toxicity"](spark, good, small).cache()
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(good, table(spark, small, "labels")).collect()}
    assert calm.columns == columns and set(texts(calm)) == {i for i, p in scores.items() if not p}
    lean = stages["line dedup"](spark, calm, small).cache()
    assert lean.columns == columns and sorted(texts(lean).items()) == plain_lines([(r["doc_id"], r["text"], r["source"]) for r in calm.collect()], 8)
    assert all(r["n_chars"] == len(r["text"]) for r in lean.collect())
    single = stages["n-gram Jaccard join"](spark, lean, small).cache()
    groups = jaccard_components(list(texts(lean).items()))
    assert single.columns == columns and set(texts(single)) == {i for i, (_, c) in groups.items() if c == i}
    pieces = stages["packing"](spark, single, small).collect()
    check(pieces, list(texts(single).items()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, pieces))


def test_repeated_rows_and_ids(spark, small, odd_docs, no_docs):
    single = corpus_pipeline.near_duplicates(spark, odd_docs, small)
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert len(rows) == len(set(rows)) == 12  # 1-4, the other text of 4, 7-9, 11, 12 and both null ids
    good = corpus_pipeline.quality_rules(spark, odd_docs, small)
    assert good.columns == odd_docs.columns and good.filter("doc_id = 4").count() == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, small).count() == 0
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_names_that_clash(spark):
    import corpus_pipeline
    from chatterlens.llm.base import row_key

    docs = spark.createDataFrame([(1, "a", 5, 6), (2, "b", 5, 6), (None, "c", 5, 6)], "doc_id long, text string, chosen_id int, chosen_key int")
    chosen = docs.filter("text <> 'b'").select("doc_id", row_key("text").alias("row_key"))
    got = corpus_pipeline._matching(docs, chosen, "text")
    assert got.columns == docs.columns and sorted(r["text"] for r in got.collect()) == ["a", "c"]
