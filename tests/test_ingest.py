"""Merging rows, depth, checks and file round trips."""

import json

import pytest
from pyspark.sql import functions as F

from chatterlens import schemas
from chatterlens.operators import ingest as ing
from chatterlens.operators import tables as tb
from chatterlens.sources import sinks
from chatterlens.sources.corpus import read_corpus
from chatterlens.streaming import streams as st
from chatterlens.sources import raw


def test_first_row_wins_and_existing_ids_stay(spark):
    new = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "x")], "id string, scraped_at long, content string")
    old = spark.createDataFrame([("b",)], "id string")
    assert [tuple(r) for r in ing.dedup_insert_ignore(new, old).collect()] == [("a", 1, "early")]


def test_user_writes(spark, small_corpus):
    incoming = spark.createDataFrame(
        [("reddit_u2", "reddit", "robert", "R", 0, 0, 0, "m"), ("new", "reddit", "eve", None, 0, 0, 0, None)], schemas.USERS
    )
    up = {r.id: r for r in ing.upsert_users(small_corpus.users, incoming, 900, "last_seen").collect()}
    assert up["reddit_u2"].username == "robert" and up["reddit_u2"].message_count == 2 and up["reddit_u2"].first_seen == 200
    assert up["reddit_u2"].last_seen == 900 and up["discord_u1"].last_seen == 100
    assert up["new"].message_count == 0 and up["new"].first_seen == 900
    ignored = {r.id: r for r in ing.insert_users_ignore(small_corpus.users, incoming, 900).collect()}
    assert ignored["reddit_u2"].username == "bob" and ignored["new"].first_seen == 900


def test_depth_of_cycles_and_unknown_parents(spark):
    rows = [("p", None), ("a", "p"), ("b", "a"), ("c", "b"), ("lost", "gone"), ("x", "y"), ("y", "x"), ("self", "self"), ("tail", "x"), ("tail2", "tail")]
    df = spark.createDataFrame(rows, "id string, parent_id string")
    rows = ing.comment_depth(df).collect()
    cyclic = {"x", "y", "self", "tail", "tail2"}
    assert {r.id: r.depth for r in rows} == {"p": 0, "a": 1, "b": 2, "c": 3, "lost": 0, **dict.fromkeys(cyclic)}
    assert {r.id for r in rows if r.on_cycle} == cyclic
    rooted = {r.id: r.depth for r in ing.comment_depth(df.filter("id in ('p','a','b','c')"), root_prefix="p").collect()}
    assert rooted == {"p": 0, "a": 0, "b": 1, "c": 2}


def test_long_chain(spark):
    df = spark.range(0, 200).select(
        F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent_id")
    )
    depth = {r.id: r.depth for r in ing.comment_depth(df).collect()}
    assert all(depth[f"n{i}"] == i for i in range(200))


def test_violations(spark, small_corpus):
    from dataclasses import replace

    assert ing.validate_corpus(small_corpus).count() == 0
    bad = spark.createDataFrame([("z", "irc", "t", "nobody", 1, 1, "s", "nowhere", None), ("z", "irc", None, "nobody", 1, 1, "s", None, None)], schemas.MESSAGES)
    entity = spark.createDataFrame([(9, "absent", "rumour", "n", None, None, None, None, None)], schemas.ENTITIES)
    dirty = replace(small_corpus, messages=small_corpus.messages.unionByName(bad), extracted_entities=small_corpus.extracted_entities.unionByName(entity))
    found = {(r.table, r.rule) for r in ing.validate_corpus(dirty).collect()}
    assert found == {
        ("messages", "platform"), ("messages", "required"), ("messages", "author_exists"), ("messages", "parent_exists"),
        ("messages", "unique_id"), ("extracted_entities", "entity_type"), ("extracted_entities", "message_exists"),
    }


def test_violations_of_every_table(spark, small_corpus):
    from dataclasses import replace

    def rules(**tables):
        return {(r.table, r.rule) for r in ing.validate_corpus(replace(small_corpus, **tables)).collect()}

    frame = spark.createDataFrame
    # The source may be missing; the time of collection and the platform may not.
    loose = frame([("z", "reddit", "t", "reddit_u2", 1, 1, None, None, None)], schemas.MESSAGES)
    assert rules(messages=small_corpus.messages.unionByName(loose)) == set()
    late = frame([("z", "reddit", "t", "reddit_u2", 1, None, "s", None, None), ("y", None, "t", "reddit_u2", 1, 1, "s", None, None)], schemas.MESSAGES)
    assert rules(messages=small_corpus.messages.unionByName(late)) == {("messages", "required")}
    users = frame([("n", None, "x", None, 0, 0, 0, None), ("o", "reddit", None, None, 0, 0, 0, None)], schemas.USERS)
    assert rules(users=small_corpus.users.unionByName(users)) == {("users", "required")}
    runs = frame([(1, "kmeans", "{}", 1, 0, 1, None, None, 5)], schemas.CLUSTERING_RUNS)
    clusters = frame([(1, "discord_1", 0, 5), (9, "discord_1", 0, 5), (1, "absent", 0, 5)], schemas.MESSAGE_CLUSTERS)
    assert rules(clustering_runs=runs, message_clusters=clusters) == {("message_clusters", "run_exists"), ("message_clusters", "message_exists")}
    labels = frame([(1, "absent", "questions", 5), (9, "discord_1", "questions", 5)], schemas.MESSAGE_TAXONOMY)
    taxonomy = frame([(1, "m", "v", 1, 1, 1, None, 5)], schemas.TAXONOMY_RUNS)
    assert rules(message_taxonomy=labels, taxonomy_runs=taxonomy) == {("message_taxonomy", "run_exists"), ("message_taxonomy", "message_exists")}
    refs = frame([(1, "absent", "c", "m", 0)], schemas.EMBEDDING_REFS)
    assert rules(embeddings_reference=refs) == {("embeddings_reference", "message_exists")}


def test_references_to_one_key_are_spread(spark, small_corpus):
    """Many references to one key, present or absent, neither meet in one task nor change the result."""
    from dataclasses import replace

    n = 300_000
    wide = spark.range(n).select(
        F.concat(F.lit("m"), "id").alias("id"), F.lit("reddit").alias("platform"), F.lit("t").alias("content"),
        F.when(F.col("id") % 2 == 0, "reddit_u2").otherwise("nobody").alias("author_id"), F.lit(1).cast("long").alias("timestamp"),
        F.lit(1).cast("long").alias("scraped_at"), F.lit("s").alias("source"), F.when(F.col("id") == 5, "absent").alias("parent_id"), F.lit(None).cast("string").alias("metadata"))
    corpus = replace(small_corpus, messages=small_corpus.messages.unionByName(wide))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "8", "false")):
            spark.conf.set(k, v)
        found = ing.validate_corpus(corpus).withColumn("part", F.spark_partition_id())
        rows = found.groupBy("rule", "part").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.sum(F.substring("key", 2, 9).cast("long") % 2).alias("odd")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    authors = [r for r in rows if r.rule == "author_exists"]
    assert sum(r.n for r in authors) == sum(r.keys for r in authors) == sum(r.odd for r in authors) == n // 2
    assert [(r.rule, r.n) for r in rows if r.rule != "author_exists"] == [("parent_exists", 1)]
    assert len(authors) == 8 and max(r.n for r in authors) < n // 8


def test_last_update_wins(spark, small_corpus):
    updates = [("reddit_u2", "reddit", name, None, 0, 0, 0, None, place) for place, name in enumerate(("alice", "zed", "mia"))]
    incoming = spark.createDataFrame(updates, schemas.USERS + ", place int")
    first = {r.id: r.username for r in ing.upsert_users(small_corpus.users, incoming, 9, "place").collect()}
    assert first["reddit_u2"] == "mia"
    tied = incoming.withColumn("place", F.lit(0))
    for order in (F.asc("username"), F.desc("username")):
        rows = ing.upsert_users(small_corpus.users, tied.orderBy(order).coalesce(1), 9, "place").collect()
        assert {r.id: r.username for r in rows}["reddit_u2"] == "zed"
    labels = spark.createDataFrame([("a", 7, 1), ("a", 2, 2)], "message_id string, cluster_id int, place int")
    none = spark.createDataFrame([], schemas.MESSAGE_CLUSTERS)
    assert [tuple(r) for r in tb.save_cluster_assignments(none, 1, labels, "place").collect()] == [(1, "a", 2)]


def test_append_knows_ids_of_any_day(spark, tmp_path):
    from chatterlens.streaming.streams import append_new

    target = str(tmp_path / "t")
    write = append_new(target)
    rows = lambda *r: spark.createDataFrame(r, "id string, content string, timestamp long")
    write(rows(("a", "x", 1_700_000_000), ("n", "x", None)), 0)
    write(rows(("a", "x", 1_700_000_000 + 5 * 86400), ("n", "x", None), ("b", "x", 5)), 1)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == ["a", "b", "n"]


def test_depth_is_filled_into_metadata(spark):
    import json

    meta = '{"type":"comment","upvotes":3,"awards":["gold"]}'
    rows = [("reddit_t1_a", "reddit_t3_p", meta), ("reddit_t1_b", "reddit_t1_a", meta), ("reddit_t3_p", None, '{"type":"post"}')]
    out = {r.id: json.loads(r.metadata) for r in ing.with_comment_depth(spark.createDataFrame(rows, "id string, parent_id string, metadata string")).collect()}
    assert out["reddit_t1_a"]["depth"] == 0 and out["reddit_t1_b"]["depth"] == 1 and out["reddit_t1_b"]["awards"] == ["gold"] and out["reddit_t3_p"] == {"type": "post"}


def test_cluster_without_checkpoint_folder_is_refused():
    from checks.cases import work_folder

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_folder(Session())


def test_corpus_round_trip(spark, small_corpus, tmp_path):
    for name in ("messages", "users", "message_taxonomy", "extracted_entities"):
        getattr(small_corpus, name).write.parquet(str(tmp_path / name))
    g = read_corpus(spark, str(tmp_path), register=True)
    assert g.messages.count() == 3 and g.vectors is None
    assert spark.sql("SELECT count(*) AS n FROM messages JOIN users ON users.id = author_id").first().n == 3


def test_exports(spark, small_corpus, tmp_path):
    from chatterlens.plans import reports as rp

    rows = tb.messages_with_author_by_category(small_corpus, ["pricing_complaints"])
    sinks.write_csv(sinks.message_export(rows), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert [r.content for r in back] == ["same here, 20/mo is too much", "Costs $20 a month\nsecond line"]
    assert back[0].date == "1970-01-01 00:05" and back[0].user_msg_count == "2"
    sinks.write_json(sinks.report_rows(rp.integration_messages(small_corpus, content=True)), str(tmp_path / "json"))
    row = json.loads(next((tmp_path / "json").glob("*.json")).read_text().splitlines()[0])
    assert row["user"] == {"username": "ann", "total_messages": 1}
    assert row["extracted_keywords"] == ["stripe"] and row["auto_categories"] == ["migration_export", "payment"]
    samples = spark.createDataFrame([(1, 5, "a", "discord", "s", "t1"), (1, 5, "b", "reddit", "r", "t2")], "cluster_id int, size long, id string, platform string, source string, preview string")
    sinks.write_cluster_samples(samples, str(tmp_path / "samples"))
    row = json.loads(next(p for p in (tmp_path / "samples").glob("*.json") if p.stat().st_size).read_text().splitlines()[0])
    assert row["size"] == 5 and [(s["id"], s["platform"], s["source"]) for s in row["samples"]] == [("a", "discord", "s"), ("b", "reddit", "r")]


def land(folder, name, ids, day="2024-06-01"):
    lines = [json.dumps({"id": i, "type": 0, "content": f"text {i}", "timestamp": f"{day}T00:00:10+00:00", "author": {"id": "9", "username": "ann"}}) for i in ids]
    (folder / name).write_text("\n".join(lines))


def test_incremental_ingest_resumes_and_adds_each_id_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    target, checkpoint = str(tmp_path / "target"), str(tmp_path / "checkpoint")

    def run(where=checkpoint):
        st.incremental_ingest(spark, str(landing), target, where, schemas.RAW_CHAT, lambda r: raw.normalize_chat(r, "general")).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(target).collect())

    land(landing, "one.json", ["1", "2", "2"])
    assert run() == ["discord_1", "discord_2"]
    land(landing, "two.json", ["2", "3"])
    assert run() == ["discord_1", "discord_2", "discord_3"]
    # A message much older than all before is kept, and a replay from the start adds nothing.
    land(landing, "three.json", ["4"], "2023-01-01")
    assert run() == ["discord_1", "discord_2", "discord_3", "discord_4"]
    assert run(str(tmp_path / "fresh")) == ["discord_1", "discord_2", "discord_3", "discord_4"]


def test_daily_counts_drop_late_rows(spark, tmp_path):
    schema = "id string, timestamp long, category string"
    source = tmp_path / "in"
    source.mkdir()
    out = str(tmp_path / "out")
    counts = st.stream_daily_category_counts(spark.readStream.schema(schema).json(str(source)), "1 day")

    def step(name, rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("id", "timestamp", "category"), r))) for r in rows))
        counts.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(
            lambda batch, epoch: batch.write.mode("append").parquet(out)
        ).start().awaitTermination()

    day = 86400
    step("a.json", [("1", 10, "bug_reports"), ("2", 20, "bug_reports"), ("3", 4 * day, "questions")])
    step("b.json", [("4", 30, "bug_reports"), ("5", 9 * day, "questions")])
    rows = {(r.day_start.timestamp(), r.category): r.n for r in spark.read.parquet(out).collect()}
    assert rows[(0.0, "bug_reports")] == 2 and rows[(4.0 * day, "questions")] == 1


def test_append_entity_ids(spark, small_corpus):
    more = spark.createDataFrame([("discord_1", "feature", "dark mode")], "message_id string, entity_type string, entity_name string")
    ids = [r.id for r in tb.append_entity(small_corpus.extracted_entities, more).collect()]
    assert len(set(ids)) == 4 and max(ids) > 3


def test_table_rules(spark, small_corpus):
    g = small_corpus
    assert [r.id for r in tb.entities_by_type(g.extracted_entities, "pain_point", 0.4).collect()] == [3, 2]
    assert {(r.name, r.frequency) for r in tb.entity_frequency(g.extracted_entities).collect()} == {("price", 2), ("stripe", 1)}
    assert [r.id for r in tb.messages_without_embeddings(g.messages, g.embeddings_reference).collect()] == ["reddit_t3_2", "reddit_t1_3"]
    assert [(r.kind, r.first_line) for r in tb.posts_and_comments(g.messages).orderBy("id").collect()] == [
        ("comment", "same here, 20/mo is too much"), ("post", "Costs $20 a month")]
    runs = spark.createDataFrame([], schemas.CLUSTERING_RUNS)
    saved = tb.save_clustering_run(runs, "kmeans", '{"k": "3"}', 3, 0, 9, {"silhouette": 0.5}, 7)
    row = tb.clustering_run_by_id(saved, 1).first()
    assert row.parameters == {"k": "3"} and row.silhouette_score == 0.5 and json.loads(row.quality_metrics) == {"silhouette": 0.5}
