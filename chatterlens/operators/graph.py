"""Nodes and edges of the user-message-category graph, as frames over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.functions.columns import first_per, name_bit, names_in_bits, pct
from chatterlens.functions.skew import spread_join
from chatterlens.session import written_once
from chatterlens.sources.corpus import Corpus

HASH_BUCKETS = 1024


def entity_name() -> Column:
    return F.coalesce("canonical_name", "entity_name")


def category_nodes(g: Corpus) -> DataFrame:
    """All categories with their number of label rows, zero included."""
    counts = g.message_taxonomy.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n"))
    return g.taxonomy.join(counts, "name", "left").select(
        "name", "description", F.coalesce("n", F.lit(0)).alias("message_count")
    )


def user_nodes(g: Corpus) -> DataFrame:
    return g.users.select("id", "platform", "username", "display_name", "message_count", "first_seen", "last_seen")


def message_nodes(g: Corpus) -> DataFrame:
    """Labelled messages with the category of the latest run."""
    latest = g.message_taxonomy.groupBy(F.col("message_id").alias("id")).agg(
        F.max_by("category", F.struct("taxonomy_run_id", "created_at", "category")).alias("category")
    )
    return g.messages.join(latest, "id").select(
        "id", "platform", "content", "author_id", "timestamp", "source", "parent_id", "category"
    )


def entity_nodes(entities: DataFrame, entity_type: str, label: str) -> DataFrame:
    """One node per entity name: the last category, how often it occurs, and its severity."""
    severity = F.max("severity") if "severity" in entities.columns else F.lit(None).cast("double")
    return (
        entities.filter(F.col("entity_type") == entity_type)
        .groupBy(entity_name().alias("name"))
        .agg(
            F.max_by("category", "id").alias("category"),
            F.count("*").alias("frequency"),
            F.coalesce(severity, F.lit(0.0)).alias("severity"),
        )
        .select(F.lit(label).alias("label"), "name", "category", "frequency", "severity")
    )


def posted_edges(g: Corpus) -> DataFrame:
    """(user, message) of labelled messages whose author is known."""
    users = g.users.select(F.col("id").alias("author_id"))
    return (
        g.classified_messages("author_id").join(users, "author_id", "left_semi")
        .select(F.col("author_id").alias("user_id"), F.col("id").alias("message_id"))
    )


def classified_as_edges(g: Corpus) -> DataFrame:
    """Distinct (message, category) where the message and the category exist."""
    ids = g.messages.select(F.col("id").alias("message_id"))
    return g.labels().join(ids, "message_id", "left_semi")


def replies_to_edges(g: Corpus) -> DataFrame:
    return g.replies()


def entity_edges(g: Corpus, entity_type: str) -> DataFrame:
    """(message, entity) with the confidence and context set last."""
    last = (
        g.extracted_entities.filter(F.col("entity_type") == entity_type)
        .groupBy("message_id", entity_name().alias("entity_name"))
        .agg(F.max_by(F.struct("confidence", "context"), "id").alias("last"))
    )
    nodes = g.classified_messages().withColumnRenamed("id", "message_id")
    return last.join(nodes, "message_id", "left_semi").select("message_id", "entity_name", "last.confidence", "last.context")


def category_recount(g: Corpus) -> DataFrame:
    """Messages per category counted from the edges, zero kept."""
    counts = classified_as_edges(g).groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n"))
    return g.taxonomy.select("name").join(counts, "name", "left").select(
        "name", F.coalesce("n", F.lit(0)).alias("message_count")
    )


def graph_stats(g: Corpus) -> DataFrame:
    """Nodes by label, edges by type, messages by category with their share, and by platform."""

    names = list(g.categories)
    # One row per message with its categories as bits, then per (platform, bits, author): all message figures come from it.
    labels = g.message_taxonomy.groupBy(F.col("message_id").alias("id")).agg(F.bit_or(name_bit("category", names)).alias("bits"))
    grouped = g.messages.select("id", "author_id", "platform").join(labels, "id").groupBy("author_id", "platform", "bits").agg(F.count("*").alias("n"))
    known = g.authors().withColumn("known", F.lit(True))
    per = grouped.join(known, "author_id", "left").groupBy("platform", "bits", "known").agg(F.sum("n").alias("n"))

    def figure(kind: str, key: Column, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), n.cast("bigint").alias("n"))

    n, zero = F.col("n"), F.lit(0)
    figures = F.concat(
        F.array(
            figure("node", F.lit("Message"), n), figure("edge", F.lit("POSTED"), F.when(F.col("known"), n).otherwise(zero)),
            figure("edge", F.lit("CLASSIFIED_AS"), n * F.bit_count("bits")), figure("platform", F.col("platform"), n),
        ),
        F.transform(names_in_bits("bits", names), lambda c: figure("category", c, F.col("n"))),
    )

    def fixed(df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.lit(key).alias("key"), F.coalesce("n", zero).cast("bigint").alias("n"))

    # Kinds that have no message still get their row.
    empty = g.spark.createDataFrame(
        [("node", "Message", 0), ("edge", "POSTED", 0), ("edge", "CLASSIFIED_AS", 0), *(("category", c, 0) for c in names)], "kind string, key string, n bigint")
    rows = per.select(F.explode(figures).alias("f")).select("f.*").unionByName(empty)
    rows = rows.unionByName(fixed(g.taxonomy.agg(F.count("*").alias("n")), "node", "Category"))
    rows = rows.unionByName(fixed(g.users.agg(F.count("*").alias("n")), "node", "User"))
    rows = rows.unionByName(fixed(g.reply_counts().agg(F.sum("n").alias("n")), "edge", "REPLIES_TO"))
    sums = rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    # A few dozen rows: the share needs the number of messages beside each.
    messages = F.max(F.when((F.col("kind") == "node") & (F.col("key") == "Message"), F.col("n"))).over(Window.partitionBy())
    return sums.withColumn("messages", messages).select("kind", "key", "n", F.when(F.col("kind") == "category", pct(F.col("n"), F.col("messages"))).alias("pct"))


def user_message_counts(g: Corpus) -> DataFrame:
    """Labelled messages per username; counted per user first, so the name join is small."""
    counts = g.classified_messages("author_id").groupBy("author_id").agg(F.count("*").alias("n"))
    return (
        counts.join(g.authors("username"), "author_id")
        .groupBy("username").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "username")
    )


def integration_request_counts(g: Corpus, k: int = 5) -> DataFrame:
    return (
        entity_edges(g, "integration").groupBy(F.col("entity_name").alias("name"))
        .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)
    )


def pain_points_by_confidence(g: Corpus) -> DataFrame:
    return entity_edges(g, "pain_point").select(F.col("entity_name").alias("name"), "confidence", "context", "message_id").orderBy(
        F.desc_nulls_first("confidence"), "name", "message_id"
    )


def _mentions(g: Corpus, entity_types: list[str]) -> DataFrame:
    """Distinct (message, entity name) with the author, of labelled messages by known users."""
    pairs = (
        g.extracted_entities.filter(F.col("entity_type").isin(entity_types))
        .select(F.col("message_id").alias("id"), entity_name().alias("name")).distinct()
    )
    posted = posted_edges(g).select(F.col("message_id").alias("id"), "user_id")
    return pairs.join(posted, "id")


def entity_mentions_top(g: Corpus, k: int = 20, entity_types: list[str] | None = None) -> DataFrame:
    """Entities by requests and distinct users; grouped per (entity, user) first."""
    per_user = _mentions(g, entity_types or ["integration"]).groupBy("name", "user_id").agg(F.count("*").alias("n"))
    return (
        per_user.groupBy("name").agg(F.sum("n").alias("request_count"), F.count("*").alias("unique_users"))
        .orderBy(F.desc("request_count"), "name").limit(k)
    )


def user_wants(g: Corpus, entity_types: list[str] | None = None) -> DataFrame:
    """How often each user asked for each integration or feature."""
    return _mentions(g, entity_types or ["integration", "feature"]).groupBy("user_id", "name").agg(F.count("*").alias("n"))


def co_requested(g: Corpus, min_strength: float = 0.3, entity_types: list[str] | None = None, min_shared: int = 2) -> DataFrame:
    """Entity pairs by shared users: n shared, strength = Jaccard of the user sets, above a threshold.

    Pairs need at least ``min_shared`` shared users. Entities that fewer users asked for can have no pair and leave
    before anything is paired: else one user who asks for everything would pair all entities nobody else wants.

    A set-similarity join with exact prefix filtering. Two entities above the
    threshold share a user among the rarest users of each, and their sizes differ
    by less than the threshold allows. So users who ask for many entities, who
    would pair all of them, generate no candidates unless a pair can qualify.
    The prefix ends at a (degree, hash bucket) boundary found on a small
    histogram: a little longer than needed, never shorter, and no task has to
    rank all users of a popular entity.
    """
    wants = written_once(user_wants(g, entity_types).select("user_id", "name"))
    enough = wants.groupBy("name").agg(F.count("*").alias("users")).filter(F.col("users") >= min_shared).select("name")
    wants = written_once(wants.join(enough, "name", "left_semi"))
    degree = wants.groupBy("user_id").agg(F.count("*").alias("degree"))
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(HASH_BUCKETS))
    # One user may ask for very many entities, and one entity may have very many users.
    tokens = spread_join(wants, degree, "user_id", "name").select(
        "user_id", "name", F.struct(F.col("degree"), bucket.alias("bucket")).alias("place")
    )
    whole = Window.partitionBy("name")
    upto = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = F.col("size") - F.ceil(F.col("size") * F.lit(min_strength)) + 1
    cut = (
        tokens.groupBy("name", "place").agg(F.count("*").alias("n"))
        .withColumn("reached", F.sum("n").over(upto)).withColumn("size", F.sum("n").over(whole))
        .filter(F.col("reached") >= needed)
        .groupBy("name").agg(F.min("place").alias("cut"), F.max("size").alias("size"))
    )
    prefix = spread_join(tokens, cut, "name", "user_id").filter(F.col("place") <= F.col("cut")).select("user_id", "name", "size")
    left = prefix.select("user_id", F.col("name").alias("a"), F.col("size").alias("size_a"))
    right = prefix.select("user_id", F.col("name").alias("b"), F.col("size").alias("size_b"))
    smaller, larger = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    candidates = (
        left.join(right, "user_id")
        .filter((F.col("a") < F.col("b")) & (smaller > larger * min_strength))
        .select("a", "b", "size_a", "size_b").distinct()
    )
    probe = candidates.select(
        "*",
        F.when(F.col("size_a") <= F.col("size_b"), F.col("a")).otherwise(F.col("b")).alias("probe"),
        F.when(F.col("size_a") <= F.col("size_b"), F.col("b")).otherwise(F.col("a")).alias("other"),
    )
    shared = (
        probe.join(wants.withColumnRenamed("name", "probe"), "probe")
        .join(wants.withColumnRenamed("name", "other"), ["other", "user_id"], "left_semi")
        .groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("n"))
    )
    strength = F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n"))
    return shared.select("a", "b", "n", strength.alias("strength")).filter((F.col("strength") > min_strength) & (F.col("n") >= min_shared))


def similar_users(g: Corpus, min_score: float = 0.5, limit: int = 50) -> DataFrame:
    """The most similar user pairs by Jaccard of their category sets, above a threshold.

    Users with the same category set are interchangeable but for their id, and ten
    categories give at most 1,023 sets. So scores are found between sets, only the
    best score levels that fill the limit are opened, and of each set only its
    first limit + 1 ids can occur among the first pairs by (score, a, b): exact,
    with work that does not grow with the number of users after one grouping.
    """
    names = list(g.categories)
    per_user = g.facts(None).groupBy("author_id").agg(F.bit_or(name_bit("category", names)).alias("key"))
    members = written_once(per_user.join(g.authors(), "author_id", "left_semi"))
    sets = members.groupBy("key").agg(F.count("*").alias("users"))
    exploded = sets.select(
        "key", "users", F.bit_count("key").alias("size"), F.explode(names_in_bits("key", names)).alias("category")
    )
    x = exploded.select("category", *[F.col(c).alias(f"{c}_x") for c in ("key", "users", "size")])
    y = exploded.select("category", *[F.col(c).alias(f"{c}_y") for c in ("key", "users", "size")])
    shared = x.join(y, "category").filter(F.col("key_x") <= F.col("key_y")).groupBy(
        "key_x", "key_y", "users_x", "users_y", "size_x", "size_y"
    ).agg(F.count("*").alias("both"))
    same = F.col("key_x") == F.col("key_y")
    pairs = (
        F.when(same, F.col("users_x") * (F.col("users_x") - 1) / 2).otherwise(F.col("users_x") * F.col("users_y"))
    ).cast("double")
    scored = shared.select(
        "key_x", "key_y", (F.col("both") / (F.col("size_x") + F.col("size_y") - F.col("both"))).alias("score"), pairs.alias("pairs")
    ).filter((F.col("score") > min_score) & (F.col("pairs") > 0))
    better = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        scored.groupBy("score").agg(F.sum("pairs").alias("level_pairs"))
        .withColumn("before", F.coalesce(F.sum("level_pairs").over(better), F.lit(0.0)))
        .filter(F.col("before") < limit)
        .select("score")
    )
    opened = scored.join(levels, "score", "left_semi")
    first_ids = first_per(members.select("key", "author_id"), ["key"], [F.asc("author_id")], limit + 1)
    left = first_ids.select(F.col("key").alias("key_x"), F.col("author_id").alias("id_x"), F.col("rank").alias("rank_x"))
    right = first_ids.select(F.col("key").alias("key_y"), F.col("author_id").alias("id_y"), F.col("rank").alias("rank_y"))
    # A pair at ranks (i, j) comes after all pairs at smaller ranks of the same two sets.
    i, j = F.col("rank_x"), F.col("rank_y")
    one_set = (i < j) & (i * j - i * (i + 1) / 2 <= limit)
    two_sets = i * j <= limit
    found = (
        opened.join(left, "key_x").join(right, "key_y")
        .filter(F.when(F.col("key_x") == F.col("key_y"), one_set).otherwise(two_sets))
        .select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), "score")
    )
    return found.orderBy(F.desc("score"), "a", "b").limit(limit)
