import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chatterlens.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.streaming.metricsEnabled": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_corpus(spark):
    """Two users, three messages, three entities, two labels, one reply."""
    from chatterlens import schemas
    from chatterlens.sources.corpus import Corpus

    messages = spark.createDataFrame([
        ("discord_1", "discord", "need a Stripe export", "discord_u1", 100, 160, "general", None, '{"type":0,"reactions":[{"emoji":"+1","count":2}]}'),
        ("reddit_t3_2", "reddit", "Costs $20 a month\nsecond line", "reddit_u2", 200, 260, "forum", None, '{"type":"post"}'),
        ("reddit_t1_3", "reddit", "same here, 20/mo is too much", "reddit_u2", 300, 360, "forum", "reddit_t3_2", "not json"),
    ], schemas.MESSAGES)
    users = spark.createDataFrame([
        ("discord_u1", "discord", "ann", None, 1, 100, 100, None), ("reddit_u2", "reddit", "bob", None, 2, 200, 300, None),
    ], schemas.USERS)
    entities = spark.createDataFrame([
        (1, "discord_1", "integration", "Stripe", "stripe", "payments", "ctx1", 0.9, None),
        (2, "reddit_t3_2", "pain_point", "price", None, "pricing", "ctx2", None, None),
        (3, "reddit_t1_3", "pain_point", "price", None, "pricing", "ctx3", 0.5, None),
    ], schemas.ENTITIES)
    labels = spark.createDataFrame([
        (1, "discord_1", "integration_requests", 10), (1, "reddit_t3_2", "questions", 10),
        (2, "reddit_t3_2", "pricing_complaints", 20), (1, "reddit_t1_3", "pricing_complaints", 10),
    ], schemas.MESSAGE_TAXONOMY)
    refs = spark.createDataFrame([(1, "discord_1", "c1", "m", 0)], schemas.EMBEDDING_REFS)
    return Corpus(messages=messages, users=users, message_taxonomy=labels, extracted_entities=entities, embeddings_reference=refs)
