"""Merging new rows into the tables, and checks on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlens.functions.columns import small
from chatterlens.functions.fixed_values import ENTITY_TYPES, PLATFORMS
from chatterlens.functions.skew import spread_join
from chatterlens.schemas import COMMENT_METADATA
from chatterlens.session import written_once
from chatterlens.sources.corpus import Corpus
from chatterlens.sources.versions import EPOCH, VersionedTable


def first_by_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in the given order; combined before the shuffle.

    ``min_by`` keeps one candidate per key and task, so copies of one key never
    meet in a single task.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(F.col(key).alias("__key"))
        .agg(F.min_by(whole, F.struct(*order)).alias("__row"))
        .select("__row.*")
    )


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by the column ``order``; combined before the shuffle.

    Rows that share key and order are settled by their contents, so the order in which files are read never counts.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(whole, F.struct(F.col(order), whole)).alias("__row")).select("__row.*")


def dedup_insert_ignore(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """The rows to insert: the first per key among the new ones, without keys that exist."""
    order = [F.col(c) for c in ("scraped_at", "content") if c in new.columns]
    order = order or [F.struct(*[F.col(c) for c in new.columns if c != key])]
    return first_by_key(new, key, *order).join(existing.select(key), key, "left_anti").select(*new.columns)


def insert_users_ignore(users: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """All users after inserting those whose id is new, with zero messages seen now."""
    fresh = first_by_key(incoming, "id", F.col("username")).join(users.select("id"), "id", "left_anti")
    fresh = (
        fresh.withColumn("message_count", F.lit(0).cast("bigint"))
        .withColumn("first_seen", F.lit(now).cast("bigint"))
        .withColumn("last_seen", F.lit(now).cast("bigint"))
    )
    return users.unionByName(fresh.select(*users.columns))


def upsert_users(users: DataFrame, incoming: DataFrame, now: int, order: str) -> DataFrame:
    """All users after an upsert: names, metadata and last_seen are replaced, count and first_seen kept.

    Of several updates of one user the last by the column ``order`` wins. ``user_store`` keeps users over many batches.
    """
    latest = last_by_key(incoming, ["id"], order)
    o, n = users.alias("o"), latest.alias("n")
    is_new, touched = F.col("o.id").isNull(), F.col("n.id").isNotNull()
    stamp = F.lit(now).cast("bigint")

    def replaced(name: str) -> Column:
        return F.when(touched, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    columns = {
        "id": F.coalesce("o.id", "n.id").alias("id"),
        "platform": F.coalesce("o.platform", "n.platform").alias("platform"),
        "username": replaced("username"),
        "display_name": replaced("display_name"),
        "message_count": F.when(is_new, F.lit(0)).otherwise(F.col("o.message_count")).cast("bigint").alias("message_count"),
        "first_seen": F.when(is_new, stamp).otherwise(F.col("o.first_seen")).alias("first_seen"),
        "last_seen": F.when(touched, stamp).otherwise(F.col("o.last_seen")).alias("last_seen"),
        "metadata": replaced("metadata"),
    }
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(*columns.values())


USER_UPDATES = "id string, platform string, username string, display_name string, metadata string, sequence long, first_seen long, last_seen long"


def user_store(spark: SparkSession, root: str, max_deltas: int = 16) -> VersionedTable:
    """Users kept over many batches of updates (``USER_UPDATES``): the last update by ``sequence`` gives the names.

    Only the batch is written, whatever the number of users; the result is the same for any order of batches and files.
    """

    def merge(rows: DataFrame) -> DataFrame:
        named = ("platform", "username", "display_name", "metadata")
        last = F.struct("sequence", *named)
        state = rows.groupBy("id").agg(
            F.max(last).alias("last"), F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"), F.max(EPOCH).alias(EPOCH))
        return state.select("id", "last.platform", "last.username", "last.display_name", "last.metadata", "last.sequence", "first_seen", "last_seen", EPOCH)

    return VersionedTable(spark, root, USER_UPDATES, merge, max_deltas)


def save_users(store: VersionedTable, incoming: DataFrame, now: int, order: str, epoch: int, run: str = "main") -> None:
    """Add a batch of user updates to a store; the same epoch again changes nothing."""
    stamp = F.lit(now).cast("long")
    rows = last_by_key(incoming.select("id", "platform", "username", "display_name", "metadata", F.col(order).cast("long").alias("sequence")), ["id"], "sequence")
    store.write(rows.withColumn("first_seen", stamp).withColumn("last_seen", stamp), epoch, run)


def user_activity_rollup(messages: DataFrame, names: str | None = None) -> DataFrame:
    """Message count, first and last message time per author, with the latest name when there is one."""
    username = F.max_by(names, F.struct("timestamp", "id")) if names else F.first("author_id")
    return messages.groupBy(F.col("author_id").alias("id"), "platform").agg(
        username.alias("username"),
        F.count("*").alias("message_count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


@dataclass(frozen=True)
class Rules:
    """What must hold in one table: columns that are filled, columns with few values, references, a unique key."""

    key: str
    required: Sequence[str]
    values: Mapping[str, Sequence[str]] = field(default_factory=dict)
    references: Sequence[tuple[str, str, str]] = ()  # (rule, column, target table)
    unique: tuple[str, Sequence[str]] | None = None
    target_key: str | None = None  # the column that references of other tables mean


#: The rules of the tables.
TABLE_RULES = {
    "messages": Rules(
        "id", ["platform", "content", "author_id", "timestamp", "scraped_at"], {"platform": PLATFORMS},
        [("author_exists", "author_id", "users"), ("parent_exists", "parent_id", "messages")], ("unique_id", ["id"]), "id"),
    "users": Rules("id", ["platform", "username"], {"platform": PLATFORMS}, unique=("unique_id", ["id"]), target_key="id"),
    "extracted_entities": Rules("id", ["message_id", "entity_type", "entity_name"], {"entity_type": ENTITY_TYPES}, [("message_exists", "message_id", "messages")]),
    "embeddings_reference": Rules(
        "message_id", ["message_id", "chromadb_id", "created_at"], references=[("message_exists", "message_id", "messages")], unique=("unique_message", ["message_id"])),
    "clustering_runs": Rules("id", ["method", "parameters", "n_clusters", "n_noise", "n_samples", "created_at"], target_key="id"),
    "message_clusters": Rules(
        "message_id", ["clustering_run_id", "message_id", "cluster_id", "created_at"],
        references=[("message_exists", "message_id", "messages"), ("run_exists", "clustering_run_id", "clustering_runs")],
        unique=("unique_assignment", ["clustering_run_id", "message_id"])),
    "taxonomy_runs": Rules("id", ["model", "taxonomy_version", "n_messages", "batch_size", "total_batches", "created_at"], target_key="id"),
    "message_taxonomy": Rules(
        "message_id", ["taxonomy_run_id", "message_id", "category", "created_at"],
        references=[("message_exists", "message_id", "messages"), ("run_exists", "taxonomy_run_id", "taxonomy_runs")]),
}


# A key that more references than this mean is looked up once for all of them; the most asked ones of each table are, so many at most.
HOT_ROWS = 100_000
HOT_KEYS = 500
COUNTED_KEYS = 5_000  # keys that a sketch counts at once; what has a five-hundredth of a table's references is always among them
NOWHERE = -1  # a target without keys


def validate_corpus(g: Corpus, rules: Mapping[str, Rules] = TABLE_RULES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every broken rule as (table, rule, key); an empty result means a sound corpus.

    Each table is read once for its rows' rules and references, once for its keys, and once to see which keys are asked for
    most. All references meet all keys in one join by (target, key); rules that are broken already take part in it under a
    target without keys, so nothing removes them. A key that very many references mean never draws them into one task: it is
    looked up once, the references to it go before the join if it exists, and else are spread like broken rules. Which
    keys are treated so changes nothing in the result.
    """
    tables = {name: df for name in rules if (df := getattr(g, name)) is not None}
    names = list(tables)
    text = lambda c: F.col(c).cast("string")
    checks: list[tuple[str, str]] = []  # (table, rule); rows carry the place in it, and the place of the target in ``names``
    spread = lambda check, key: F.xxhash64(check, key).cast("string")

    def events(name: str, df: DataFrame) -> DataFrame:
        """(check, key, target, ref): broken rules, and references to be looked up."""
        r = rules[name]

        def event(rule: str, when: Column, target: int = NOWHERE, ref: Column | None = None) -> Column:
            checks.append((name, rule))
            check, key = F.lit(len(checks) - 1), text(r.key)
            ref = spread(check, key) if ref is None else ref
            return F.when(when, F.struct(check.alias("check"), key.alias("key"), F.lit(target).alias("target"), ref.alias("ref")))

        found = [event("required", F.greatest(*[F.col(c).isNull() for c in r.required], F.lit(False)))]
        found += [event(c, F.col(c).isNotNull() & ~F.col(c).isin(list(values))) for c, values in r.values.items()]
        found += [event(rule, F.col(c).isNotNull(), names.index(target), text(c)) for rule, c, target in r.references if target in tables]
        return df.select(F.explode(F.array_compact(F.array(*found))).alias("e")).select("e.*")

    def references(name: str, df: DataFrame) -> list[DataFrame]:
        pairs = [F.struct(F.lit(names.index(target)).alias("target"), text(c).alias("ref")) for _, c, target in rules[name].references if target in tables]
        return [df.select(F.explode(F.array(*pairs)).alias("e")).select("e.*").filter("ref IS NOT NULL")] if pairs else []

    def keys(name: str, df: DataFrame) -> DataFrame:
        r = rules[name]
        columns = list(r.unique[1]) if r.unique else [r.target_key]
        return df.select(
            F.lit(names.index(name)).alias("target"), F.concat_ws("/", *columns).alias("ref"), F.greatest(*[F.col(c).isNotNull() for c in columns], F.lit(False)).alias("real"))

    keyed = [keys(name, df) for name, df in tables.items() if rules[name].unique or rules[name].target_key]
    counts = reduce(DataFrame.unionByName, keyed).groupBy("target", "ref").agg(F.count("*").alias("n"), F.max("real").alias("real"))
    real = counts.filter("real").select("target", "ref")
    asked = reduce(DataFrame.unionByName, [events(name, df) for name, df in tables.items()])
    if pairs := [frame for name, df in tables.items() for frame in references(name, df)]:
        most = F.call_function("approx_top_k", F.col("ref"), F.lit(HOT_KEYS), F.lit(COUNTED_KEYS))
        often = reduce(DataFrame.unionByName, pairs).groupBy("target").agg(most.alias("most")).select("target", F.inline("most"))
        often = often.filter(F.col("count") >= hot_rows).select("target", F.col("item").alias("ref"))
        listed = HOT_KEYS * len(names)
        exists = real.join(small(often, listed), ["target", "ref"], "left_semi").withColumn("exists", F.lit(True))
        hot = often.join(exists, ["target", "ref"], "left").select("target", "ref", F.coalesce("exists", F.lit(False)).alias("exists"))
        asked = asked.join(small(hot, listed), ["target", "ref"], "left").filter(F.col("exists").isNull() | ~F.col("exists"))
        cold = F.col("exists").isNull()
        asked = asked.select(
            "check", "key", F.when(cold, F.col("target")).otherwise(F.lit(NOWHERE)).alias("target"), F.when(cold, F.col("ref")).otherwise(spread(F.col("check"), F.col("key"))).alias("ref"))
    named = lambda values, place: F.array(*[F.lit(v).cast("string") for v in values])[F.col(place)]
    lost = asked.join(real, ["target", "ref"], "left_anti").select(
        named([name for name, _ in checks], "check").alias("table"), named([rule for _, rule in checks], "check").alias("rule"), "key")
    unique = {names.index(name): rules[name].unique[0] for name in names if rules[name].unique}
    repeated = counts.filter(F.col("target").isin(list(unique)) & (F.col("n") > 1))
    return lost.unionByName(repeated.select(named(names, "target").alias("table"), named([unique.get(i) for i in range(len(names))], "target").alias("rule"), F.col("ref").alias("key")))


def comment_depth(messages: DataFrame, root_prefix: str | None = None) -> DataFrame:
    """(id, depth, on_cycle): the number of ancestors of each message; without a known parent the depth is 0.

    Messages whose id starts with ``root_prefix`` (posts) do not count as ancestors. A message whose chain of parents
    runs into a cycle has no depth: it is null, and ``on_cycle`` is true.

    Pointer doubling over narrow (id, ancestor, depth) rows: each round doubles the distance covered, so about
    log2(longest chain) joins are enough. It ends when no chain is open; what is open after as many steps as there are
    replies hangs on a cycle. Rows whose chain has ended are not joined again.
    """
    known = messages.select(F.col("id").alias("parent_id"))
    if root_prefix:
        known = known.filter(~F.col("parent_id").startswith(root_prefix))
    replies = messages.filter(F.col("parent_id").isNotNull() & (F.col("parent_id") != ""))
    # One message may have drawn a large part of all replies.
    start = written_once(
        spread_join(replies.select("id", "parent_id"), known, "parent_id", "id", "left_semi")
        .select("id", F.col("parent_id").alias("ancestor"), F.lit(1).cast("bigint").alias("depth"))
    )
    total = still = start.count()
    steps, span = start, 1
    while still and span <= total:
        # ``steps`` says for every reply how far its known ancestor is; rows with an open end are looked up in it.
        ahead = steps.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        steps = written_once(
            spread_join(steps.filter("ancestor IS NOT NULL"), ahead, "ancestor", "id", "left")
            .select("id", F.col("next").alias("ancestor"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
            .unionByName(steps.filter("ancestor IS NULL"))
        )
        still = steps.filter("ancestor IS NOT NULL").count()
        span *= 2
    cyclic = F.col("ancestor").isNotNull()
    return messages.select("id").join(steps, "id", "left").select(
        "id", F.when(~cyclic, F.coalesce("depth", F.lit(0))).cast("bigint").alias("depth"), cyclic.alias("on_cycle")
    )


def with_comment_depth(comments: DataFrame, root_prefix: str = "reddit_t3_") -> DataFrame:
    """Forum comments with ``depth`` filled into their metadata; null on a cycle, and other rows as they are."""
    depths = comment_depth(comments, root_prefix).select("id", "depth")
    filled = F.to_json(F.from_json("metadata", COMMENT_METADATA).withField("depth", F.col("depth").cast("int")))
    is_comment = F.get_json_object("metadata", "$.type") == "comment"
    return comments.join(depths, "id").withColumn("metadata", F.when(is_comment, filled).otherwise(F.col("metadata"))).select(*comments.columns)
