"""Normalising raw records."""

import json

import pytest
from pyspark.sql import functions as F

from chatterlens import schemas
from chatterlens.sources import raw


def chat(**fields):
    row = {"id": "1", "type": 0, "content": "hi", "timestamp": "2024-01-01T00:00:10.500000+00:00",
           "author": {"id": "9", "username": "ann"}}
    return json.dumps({**row, **fields})


def read(spark, tmp_path, lines, schema):
    path = tmp_path / "raw.json"
    path.write_text("\n".join(lines), encoding="utf-8")
    return spark.read.schema(schema).json(str(path))


def test_chat(spark, tmp_path):
    rows = read(spark, tmp_path, [
        chat(id="1", content="\n\t hello　\n"),
        chat(id="2", author={"id": "8", "username": "helper", "bot": True}),
        chat(id="3", content=" \n"),
        chat(id="4", content="", attachments=[{"url": "u", "filename": "f", "content_type": "image/png"}]),
        chat(id="5", content="", embeds=[{"title": "t"}]),
        chat(id="6", type=19, referenced_message={"id": "1"}, mentions=[{"id": "9"}], timestamp="2024-01-01T02:00:10+02:00",
             reactions=[{"emoji": {"name": "+1"}, "count": 2}]),
    ], schemas.RAW_CHAT)
    out = {r.id: r for r in raw.normalize_chat(rows, "general").collect()}
    assert set(out) == {"discord_1", "discord_4", "discord_5", "discord_6"}
    assert out["discord_1"].content == "hello"
    assert out["discord_1"].timestamp == out["discord_6"].timestamp == 1704067210
    assert out["discord_6"].parent_id == "discord_1" and out["discord_1"].parent_id is None
    meta = json.loads(out["discord_6"].metadata)
    assert meta["type"] == 19 and meta["mentions"] == ["discord_9"] and meta["reactions"] == [{"emoji": "+1", "count": 2}]
    assert json.loads(out["discord_5"].metadata)["embeds"] == 1
    stats = {r.reason: r.n for r in raw.ingest_stats(rows, raw.drop_reason_chat(), F.col("author.id")).collect()}
    assert stats == {"kept": 4, "skipped_bots": 1, "skipped_empty": 1}


def post(**fields):
    row = {"id": "p", "title": "Title", "selftext": "Body", "author": "ann", "created_utc": 1704067200.0, "score": 3,
           "upvote_ratio": 0.9, "num_comments": 1, "is_self": True, "permalink": "/r/x/p", "all_awardings": [{"name": "gold"}],
           "stickied": False, "locked": False}
    return json.dumps({**row, **fields})


def test_posts(spark, tmp_path):
    rows = read(spark, tmp_path, [
        post(id="a"), post(id="b", selftext=""), post(id="c", selftext="  "), post(id="d", selftext="[removed]"),
        post(id="e", author="robotfan"), post(id="f", author=None), post(id="g", author="[deleted]"),
    ], schemas.RAW_POST)
    out = {r.id: r for r in raw.normalize_forum_posts(rows, "x").collect()}
    assert set(out) == {"reddit_t3_a", "reddit_t3_c"}
    stats = {r.reason: (r.n, r.authors) for r in raw.ingest_stats(rows, raw.drop_reason_forum("selftext"), "author").collect()}
    assert stats == {"kept": (2, 1), "skipped_deleted": (4, 2), "skipped_bots": (1, 1)}
    assert out["reddit_t3_a"].content == "Title\n\nBody"
    assert out["reddit_t3_c"].content == "Title"
    meta = json.loads(out["reddit_t3_a"].metadata)
    assert meta["awards"] == ["gold"] and meta["permalink"] == "https://reddit.com/r/x/p" and meta["type"] == "post"


def comment(id, parent, **fields):
    return {"id": id, "body": f" text {id} ", "author": "ann", "parent_id": parent, "created_utc": 1704067200.0,
            "score": 1, "is_submitter": False, "permalink": "/p", **fields}


def test_comments_and_tree(spark, tmp_path):
    tree = comment("a", "t3_p", replies=[
        comment("b", "t1_a", replies=[comment("c", "t1_b"), comment("d", "t1_b", author="[deleted]")]),
        comment("e", "t1_a", body="[removed]"),
    ])
    rows = read(spark, tmp_path, [json.dumps(tree), json.dumps(comment("f", "t3_p"))], schemas.comment_tree(3))
    flat = raw.flatten_comment_tree(rows, 3)
    assert sorted(r.id for r in flat.collect()) == ["a", "b", "c", "d", "e", "f"]
    out = {r.id: r for r in raw.normalize_forum_comments(flat, "x").collect()}
    assert set(out) == {"reddit_t1_a", "reddit_t1_b", "reddit_t1_c", "reddit_t1_f"}
    assert out["reddit_t1_b"].parent_id == "reddit_t1_a" and out["reddit_t1_a"].parent_id == "reddit_t3_p"
    assert out["reddit_t1_a"].content == "text a"
    with pytest.raises(ValueError):
        raw.flatten_comment_tree(rows, 2)


def test_bot_and_deleted_rules(spark):
    df = spark.createDataFrame([("Robotfan", "x"), ("AutoModerator", "x"), ("ann", "[deleted]"), ("bob", "x"), (None, "x")], "author string, body string")
    assert [r.author for r in raw.filter_bot_authors(df, "author").collect()] == ["ann", "bob", None]
    assert [r.author for r in raw.filter_deleted(df, "body", "author").collect()] == ["Robotfan", "AutoModerator", "bob"]


def test_bad_metadata_keeps_text(spark, small_corpus):
    rows = {r.id: r for r in raw.parse_metadata(small_corpus.messages, schemas.CHAT_METADATA).collect()}
    assert rows["discord_1"].parsed.type == 0
    assert rows["reddit_t1_3"].metadata == "not json" and rows["reddit_t1_3"].parsed is None or rows["reddit_t1_3"].parsed.type is None
