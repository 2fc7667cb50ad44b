"""Look-ups, lists and counts over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlens.functions.columns import first_per, newest_first, pct, small
from chatterlens.operators.ingest import first_by_key, last_by_key
from chatterlens.sources.corpus import Corpus


def message_by_id(messages: DataFrame, id: str) -> DataFrame:
    return messages.filter(F.col("id") == id)


def messages_by_platform(messages: DataFrame, platform: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One platform's messages, newest first."""
    rows = messages.filter(F.col("platform") == platform).orderBy(*newest_first())
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def messages_by_timerange(messages: DataFrame, start: int, end: int, platform: str | None = None) -> DataFrame:
    """Messages from start to end, both included, oldest first."""
    rows = messages.filter(F.col("timestamp").between(start, end))
    if platform is not None:
        rows = rows.filter(F.col("platform") == platform)
    return rows.orderBy("timestamp", "id")


def message_count(messages: DataFrame, platform: str | None = None) -> DataFrame:
    rows = messages if platform is None else messages.filter(F.col("platform") == platform)
    return rows.agg(F.count("*").alias("n"))


def user_by_id(users: DataFrame, id: str) -> DataFrame:
    return users.filter(F.col("id") == id)


def top_users_by_activity(users: DataFrame, limit: int = 50) -> DataFrame:
    return users.orderBy(F.desc("message_count"), "id").limit(limit)


def append_entity(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """All entities with new rows appended under fresh ids.

    Ids are unique and larger than every present one; they need not be dense, so
    no single task has to number all rows.
    """
    last = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    fresh = rows.withColumn("id", F.monotonically_increasing_id() + 1 + last.scalar())
    return entities.unionByName(fresh, allowMissingColumns=True)


def entities_by_type(entities: DataFrame, entity_type: str, min_confidence: float = 0.0) -> DataFrame:
    """Entities of a type that have no confidence or enough of it, most confident first."""
    enough = F.col("confidence").isNull() | (F.col("confidence") >= min_confidence)
    return entities.filter((F.col("entity_type") == entity_type) & enough).orderBy(F.desc_nulls_last("confidence"), "id")


def entity_frequency(entities: DataFrame) -> DataFrame:
    name = F.coalesce("canonical_name", "entity_name").alias("name")
    return (
        entities.groupBy("entity_type", name)
        .agg(F.count("*").alias("frequency"))
        .orderBy(F.desc("frequency"), "entity_type", "name")
    )


def embedding_refs(refs: DataFrame, incoming: DataFrame, model: str) -> DataFrame:
    """All references after adding those of messages that have none."""
    fresh = (
        first_by_key(incoming, "message_id", F.col("chromadb_id"))
        .join(refs.select("message_id"), "message_id", "left_anti")
        .withColumn("embedding_model", F.lit(model))
    )
    return refs.unionByName(fresh, allowMissingColumns=True)


def messages_without_embeddings(messages: DataFrame, refs: DataFrame, min_length: int = 20) -> DataFrame:
    """Messages of enough length without a reference; sort them where the order matters."""
    return (
        messages.filter(F.length("content") >= min_length)
        .join(refs.select(F.col("message_id").alias("id")), "id", "left_anti")
        .select(*messages.columns)
    )


def corpus_stats(g: Corpus) -> DataFrame:
    """Totals, counts per platform and entity type, and the date range as (metric, key, value)."""

    def counts(df: DataFrame, column: str, total: str, each: str) -> DataFrame:
        """Rows per value and in all; the total is summed from the counts, so the table is read once."""
        per = df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("value"))
        everything = per.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(
            F.lit(total).alias("metric"), F.lit("").alias("key"), "value"
        )
        return per.select(F.lit(each).alias("metric"), "key", "value").unionByName(everything)

    span = g.messages.agg(F.min("timestamp").alias("first_message"), F.max("timestamp").alias("last_message")).select(
        F.stack(F.lit(2), F.lit("first_message"), "first_message", F.lit("last_message"), "last_message").alias("metric", "value")
    ).select("metric", F.lit("").alias("key"), "value")
    result = (
        counts(g.messages, "platform", "total_messages", "messages_by_platform")
        .unionByName(span)
        .unionByName(counts(g.users, "platform", "total_users", "users_by_platform"))
    )
    if g.extracted_entities is not None:
        result = result.unionByName(counts(g.extracted_entities, "entity_type", "total_entities", "entities_by_type"))
    if g.embeddings_reference is not None:
        refs = g.embeddings_reference.agg(F.count("*").alias("value"))
        result = result.unionByName(refs.select(F.lit("total_embeddings").alias("metric"), F.lit("").alias("key"), "value"))
    return result


def save_clustering_run(runs: DataFrame, method: str, parameters: str, n_clusters: int, n_noise: int,
                        n_samples: int, scores: dict[str, float], now: int) -> DataFrame:
    """The run table with one more run; its id follows the largest one."""
    import json

    last = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    row = last.select(
        (F.col("last") + 1).alias("id"),
        F.lit(method).alias("method"), F.lit(parameters).alias("parameters"),
        F.lit(n_clusters).cast("bigint").alias("n_clusters"), F.lit(n_noise).cast("bigint").alias("n_noise"),
        F.lit(n_samples).cast("bigint").alias("n_samples"),
        F.lit(scores.get("silhouette")).cast("double").alias("silhouette_score"),
        F.lit(json.dumps(scores, sort_keys=True)).alias("quality_metrics"),
        F.lit(now).cast("bigint").alias("created_at"),
    )
    return runs.unionByName(row)


def save_cluster_assignments(existing: DataFrame, run_id: int, labels: DataFrame, order: str) -> DataFrame:
    """Assignments after writing a run's labels; a label replaces the one of the same run and message.

    Of several labels of one message the last by the column ``order`` wins.
    """
    columns = [F.lit(run_id).cast("bigint").alias("clustering_run_id"), "message_id", "cluster_id"]
    latest = last_by_key(labels.select(*columns, order), ["message_id"], order)
    latest = latest.select("clustering_run_id", "message_id", "cluster_id")
    kept = existing.select("clustering_run_id", "message_id", "cluster_id").join(
        latest.select("clustering_run_id", "message_id"), ["clustering_run_id", "message_id"], "left_anti"
    )
    return kept.unionByName(latest)


def cluster_messages(messages: DataFrame, assignments: DataFrame, run_id: int, cluster_id: int,
                     limit: int | None = None) -> DataFrame:
    """The messages of one cluster, newest first."""
    members = assignments.filter((F.col("clustering_run_id") == run_id) & (F.col("cluster_id") == cluster_id))
    rows = messages.join(members.select(F.col("message_id").alias("id")), "id").select(*messages.columns)
    rows = rows.orderBy(*newest_first())
    return rows if limit is None else rows.limit(limit)


def clustering_run_by_id(runs: DataFrame, id: int) -> DataFrame:
    """One run with its parameters as a map."""
    return runs.filter(F.col("id") == id).withColumn("parameters", F.from_json("parameters", "map<string,string>"))


def unclassified_messages(messages: DataFrame, message_taxonomy: DataFrame, min_length: int = 10,
                          limit: int | None = None) -> DataFrame:
    """Messages of enough length without any label; under a limit the newest, in order."""
    rows = (
        messages.filter(F.length("content") >= min_length)
        .join(message_taxonomy.select(F.col("message_id").alias("id")), "id", "left_anti")
        .select("id", "content", "platform", "timestamp")
    )
    return rows if limit is None else rows.orderBy(*newest_first()).limit(limit)


def save_classifications(message_taxonomy: DataFrame, run_id: int, labels: DataFrame, now: int) -> DataFrame:
    """The label table with a run's labels appended; earlier labels stay."""
    fresh = labels.select(
        F.lit(run_id).cast("bigint").alias("taxonomy_run_id"), "message_id", "category",
        F.lit(now).cast("bigint").alias("created_at"),
    )
    return message_taxonomy.unionByName(fresh, allowMissingColumns=True)


def taxonomy_run_row(message_taxonomy: DataFrame, run_id: int, model: str, version: str, batch_size: int,
                     seconds: float, now: int) -> DataFrame:
    """The run row with sizes counted from the labels written."""
    return message_taxonomy.filter(F.col("taxonomy_run_id") == run_id).agg(F.count("*").alias("n_messages")).select(
        F.lit(run_id).cast("bigint").alias("id"), F.lit(model).alias("model"), F.lit(version).alias("taxonomy_version"),
        "n_messages", F.lit(batch_size).cast("bigint").alias("batch_size"),
        F.ceil(F.col("n_messages") / batch_size).alias("total_batches"),
        F.lit(seconds).cast("double").alias("processing_time_seconds"),
        F.lit(now).cast("bigint").alias("created_at"),
    )


def latest_taxonomy_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def taxonomy_breakdown(message_taxonomy: DataFrame, run: DataFrame) -> DataFrame:
    """Messages per category of a run (one row: id, n_messages) and their share of the run size."""
    one = small(run.select(F.col("id").alias("taxonomy_run_id"), "n_messages").limit(1), 1)
    return (
        message_taxonomy.join(one, "taxonomy_run_id")
        .groupBy("category", "n_messages")
        .agg(F.count("*").alias("n"))
        .select("category", "n", pct(F.col("n"), F.col("n_messages")).alias("pct"))
        .orderBy(F.desc("n"), "category")
    )


def taxonomy_samples(messages: DataFrame, message_taxonomy: DataFrame, run_id: int, categories: int = 5,
                     n: int = 3) -> DataFrame:
    """Newest previews in the largest categories of a run."""
    run = message_taxonomy.filter(F.col("taxonomy_run_id") == run_id)
    largest = (
        run.groupBy("category").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "category").limit(categories)
    )
    wanted = run.join(small(largest.select("category"), categories), "category", "left_semi")
    # The texts are cut where they are read: no shuffle carries them whole.
    preview = F.regexp_replace(F.substring("content", 1, 100), "\n", " ").alias("preview")
    rows = messages.select("id", "platform", preview, "timestamp").join(wanted.select(F.col("message_id").alias("id"), "category"), "id")
    return first_per(rows, ["category"], newest_first(), n).select("category", "rank", "platform", "preview")


def cluster_counts(assignments: DataFrame, run_id: int) -> DataFrame:
    return (
        assignments.filter(F.col("clustering_run_id") == run_id)
        .groupBy("cluster_id").agg(F.count("*").alias("n"))
        .orderBy("cluster_id")
    )


def posts_and_comments(messages: DataFrame, post_prefix: str = "reddit_t3_", comment_prefix: str = "reddit_t1_") -> DataFrame:
    """Posts and comments told apart by id prefix, with the first line of the text."""
    kind = F.when(F.col("id").startswith(post_prefix), "post").when(F.col("id").startswith(comment_prefix), "comment")
    return messages.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "id", "kind", "parent_id", F.split_part("content", F.lit("\n"), F.lit(1)).alias("first_line")
    )


def messages_with_author_by_category(g: Corpus, categories: list[str], messages: DataFrame | None = None) -> DataFrame:
    """Messages of the categories with their author, one row per label row.

    Unordered: reports aggregate it, and the exports sort it once at the end.
    ``messages`` may be a prepared frame, for instance one whose texts were already
    reduced to keywords, so that only those are shuffled.
    """
    labels = g.message_taxonomy.filter(F.col("category").isin(categories)).select(F.col("message_id").alias("id"), "category")
    m = g.messages.select("id", "content", "platform", "timestamp", "source", "author_id") if messages is None else messages
    u = g.users.select(F.col("id").alias("author_id"), "username", "message_count")
    return m.join(labels, "id").join(u, "author_id").drop("author_id")
