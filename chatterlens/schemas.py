"""Table and raw-record schemas, as DDL strings."""

from __future__ import annotations

MESSAGES = (
    "id string, platform string, content string, author_id string, timestamp bigint, "
    "scraped_at bigint, source string, parent_id string, metadata string"
)
USERS = (
    "id string, platform string, username string, display_name string, "
    "message_count bigint, first_seen bigint, last_seen bigint, metadata string"
)
ENTITIES = (
    "id bigint, message_id string, entity_type string, entity_name string, canonical_name string, "
    "category string, context string, confidence double, extraction_metadata string"
)
EMBEDDING_REFS = (
    "id bigint, message_id string, chromadb_id string, embedding_model string, created_at bigint"
)
CLUSTERING_RUNS = (
    "id bigint, method string, parameters string, n_clusters bigint, n_noise bigint, n_samples bigint, "
    "silhouette_score double, quality_metrics string, created_at bigint"
)
MESSAGE_CLUSTERS = (
    "clustering_run_id bigint, message_id string, cluster_id int, created_at bigint"
)
TAXONOMY_RUNS = (
    "id bigint, model string, taxonomy_version string, n_messages bigint, batch_size bigint, "
    "total_batches bigint, processing_time_seconds double, created_at bigint"
)
MESSAGE_TAXONOMY = (
    "taxonomy_run_id bigint, message_id string, category string, created_at bigint"
)
VECTORS = (
    "message_id string, embedding array<float>, platform string, source string, timestamp bigint, "
    "author_id string, content_preview string"
)
TABLES = {
    "messages": MESSAGES,
    "users": USERS,
    "extracted_entities": ENTITIES,
    "embeddings_reference": EMBEDDING_REFS,
    "clustering_runs": CLUSTERING_RUNS,
    "message_clusters": MESSAGE_CLUSTERS,
    "taxonomy_runs": TAXONOMY_RUNS,
    "message_taxonomy": MESSAGE_TAXONOMY,
    "vectors": VECTORS,
}

RAW_CHAT = (
    "id string, type int, content string, timestamp string, edited_timestamp string, "
    "author struct<id:string,username:string,bot:boolean>, "
    "referenced_message struct<id:string>, mentions array<struct<id:string>>, mention_roles array<string>, "
    "attachments array<struct<url:string,filename:string,content_type:string>>, "
    "embeds array<struct<title:string>>, reactions array<struct<emoji:struct<name:string>,count:int>>"
)
RAW_POST = (
    "id string, title string, selftext string, author string, created_utc double, score int, "
    "upvote_ratio double, num_comments int, link_flair_text string, is_self boolean, url string, "
    "permalink string, all_awardings array<struct<name:string>>, stickied boolean, locked boolean"
)
COMMENT_FIELDS = {
    "id": "string", "body": "string", "author": "string", "parent_id": "string", "created_utc": "double",
    "score": "int", "is_submitter": "boolean", "permalink": "string", "all_awardings": "array<struct<name:string>>",
}
RAW_COMMENT = ", ".join(f"{name} {kind}" for name, kind in COMMENT_FIELDS.items())

CHAT_METADATA = (
    "type int, edited_timestamp string, mentions array<string>, mention_roles array<string>, "
    "attachments array<struct<url:string,filename:string,content_type:string>>, embeds int, "
    "reactions array<struct<emoji:string,count:int>>"
)
POST_METADATA = (
    "type string, upvotes int, upvote_ratio double, num_comments int, flair string, is_self_post boolean, "
    "url string, permalink string, awards array<string>, is_stickied boolean, is_locked boolean"
)
COMMENT_METADATA = (
    "type string, upvotes int, depth int, is_top_level boolean, is_submitter boolean, permalink string, "
    "awards array<string>"
)


def comment_tree(levels: int) -> str:
    """The raw comment schema with ``replies`` nested to a number of levels."""
    inner = ",".join(f"{name}:{kind}" for name, kind in COMMENT_FIELDS.items())
    nested = f"struct<{inner}>"
    for _ in range(levels - 2):
        nested = f"struct<{inner},replies:array<{nested}>>"
    return RAW_COMMENT if levels < 2 else f"{RAW_COMMENT}, replies array<{nested}>"
